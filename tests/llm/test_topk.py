import math

import numpy as np
from pyspark.sql import functions as F
from tidemesh.llm import topk


def brute(rows, k, every):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in (i for i in whole if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_equals_brute_force_with_ties_and_unusable_rows(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[40][1]) for i in range(15)] + [(500, None), (600, [1.0, None]), (700, [math.nan] * 8), (800, [math.inf] * 8), (900, [0.5] * 3), (901, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(5)
    assert found(topk.search(df, 10, 20)) == brute(rows, 10, 20)


def test_query_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert found(topk.search(df, 3, 5)) == brute(rows, 3, 5)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert found(topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema))) == {0: [(1, 1, 1024 * 2048)]}
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert topk.search(spark.createDataFrame([], schema)).count() == 0


def test_elimination_skips_candidates():
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 6)) * 4000
    x = np.floor(np.repeat(centres, 500, axis=0) + r.normal(size=(10000, 6)) * 50)
    best = topk.Best(np.array([-1]), x[:1], topk.spread(x[::50], 24), 10)
    best.offer(np.arange(len(x)), x)
    assert best.evaluated < len(x) / 3
    assert best.found[0][0].tolist() == sorted((x @ x[0]).tolist())[::-1][:10]


def test_large_components_are_exact_or_refused(spark):
    import pytest

    schema = "vec_id long, embedding array<double>"
    rows = [(0, [3.0e6, -1.0]), (1, [2.9e6, 5.0]), (2, [2.9e6, 4.0])]
    assert found(topk.search(spark.createDataFrame(rows, schema))) == brute(rows, 10, 100)
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [1e200]), (1, [1e200])], schema)).collect()
