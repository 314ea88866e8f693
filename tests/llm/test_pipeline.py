"""The pipeline on a small table against plain Python for each stage."""

import random
import re
from collections import defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F
from tidemesh.llm import mixing, packing

from tests.llm.test_jaccard import brute as components
from tests.llm.test_spans import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def without_repeats(texts, n=50):
    seen, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        for j in range(len(w) - n + 1):
            seen.setdefault(tuple(w[j : j + n]), i)
    for i, t in texts.items():
        w = WORD.findall(t)
        gone = set()
        for j in range(len(w) - n + 1):
            if seen[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    return {i: t for i, t in out.items() if t}


def test_stages(spark):
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    more = [(10_000 + i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(corpus())]
    docs = table(spark, real + more)
    kept = P.language_id(spark, docs, "")
    assert kept.columns == list(P.COLUMNS)
    first = rows_of(kept)
    letters = {r[0] for r in real + more if r[1] and any(c.isalpha() for c in r[1])}
    assert set(first) <= letters and len(letters) - len(first) <= 2 and {r[0] for r in real} & letters <= set(first)

    second = rows_of(P.near_duplicates(spark, kept, ""))
    assert set(second) == {c for _, _, c in components([(i, r.text) for i, r in first.items()])}
    third_df = P.repeated_passages(spark, table(spark, [tuple(r[c] for c in P.COLUMNS) for r in second.values()]), "")
    third = rows_of(third_df)
    assert {i: r.text for i, r in third.items()} == without_repeats({i: r.text for i, r in second.items()})

    fourth_df = P.source_mix(spark, table(spark, [tuple(r[c] for c in P.COLUMNS) for r in third.values()]), "")
    fourth = rows_of(fourth_df)
    taken = {r.doc_id: r.taken for r in mixing.mix(third_df)[0].collect()}
    by_source, size = defaultdict(int), defaultdict(int)
    for i, r in third.items():
        w = WORD.findall(r.text)
        size[r.source] += len(w)
        got = WORD.findall(fourth[i].text) if i in fourth else []
        assert len(got) == taken[i] <= 2 * len(w) and got == (w + w)[: len(got)]
        by_source[r.source] += len(got)
    for s, _, target in mixing.targets(list(size.items())):
        assert abs(by_source[s] - target) <= 0.02 * target + 20

    last = P.packed(spark, table(spark, [tuple(r[c] for c in P.COLUMNS) for r in fourth.values()]), "").collect()
    tok = packing._tokenizer(packing.vocabulary())
    lengths = defaultdict(int)
    for r in last:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in fourth.items()}
    filled = defaultdict(int)
    for r in last:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY and len(filled) <= sum(filled.values()) / packing.CAPACITY * 1.02 + 1


def test_run_and_registration(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and P.ORACLE_SQL is None and len(P.STAGES) == 5
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_on_empty_tables(spark):
    for name, stage in P.STAGES:
        assert stage(spark, table(spark, []), "").count() == 0, name


def prose(seed, n=120):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    x, y, z, u, v, w = (prose(i) for i in range(6))
    copy = lambda t, end="": " ".join([*t[:-1], "changed" + end])
    x, y, z, u, v, w, cx, cz, cv = *(" ".join(t) for t in (x, y, z, u, v, w)), copy(x), copy(z), copy(v)
    rows = [(1, x), (1, y), (2, cx), (3, cx), (3, w), (None, z), (None, cz), (None, u), (None, cx), (5, v), (5, v), (5, cv), (7, " "), (7, " "), (None, "")]
    got = texts_of(P.near_duplicates(spark, table(spark, [(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)]), ""))
    (zs,) = {(None, z), (None, cz)} & set(got)
    (vs,) = {(5, v), (5, cv)} & set(got)
    assert got == sorted([(1, x), (1, y), (3, w), zs, (None, u), vs, (7, " "), (7, " "), (None, "")], key=repr)


def test_repeated_passages_of_null_and_repeated_ids(spark):
    p, a, b, c, d, e = prose(10, 60), *(prose(i, 20) for i in range(11, 16))
    join = lambda *parts: " ".join(sum(parts, []))
    rows = [(1, join(p, a)), (2, join(b, p)), (2, join(c)), (None, join(d, p)), (None, join(e)), (None, None)]
    got = texts_of(P.repeated_passages(spark, table(spark, [(i, t, "en", "s", 0) for i, t in rows]), ""))
    assert got == sorted([(1, join(p, a)), (2, join(b)), (2, join(c)), (None, join(d)), (None, join(e))], key=repr)


def test_source_mix_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(prose(i, 30)) for i in range(20, 23))
    rows = [(1, a, "en", "s", 0), (1, "", "en", "s", 0), (1, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "de", "s", 0), (None, a, "en", None, 0)]
    got = P.source_mix(spark, table(spark, rows), "").collect()
    words, target = defaultdict(int), {s: t for s, _, t in mixing.targets([("s", 120), (None, 30)])}
    for r in got:
        (w,) = [x[1].split() for x in rows if (x[0], x[2], x[3]) == (r.doc_id, r.lang, r.source) and x[1].startswith(r.text.split()[0])]
        found = r.text.split()
        assert found == (w + w)[: len(found)]
        words[r.source] += len(found)
    assert dict(words) == {s: round(t) for s, t in target.items()}


def test_stages_ignore_columns_with_clashing_names(spark):
    rows = [(i, " ".join(prose(i % 7, 60)), "en", f"s{i % 2}", 0) for i in range(20)]
    docs = table(spark, rows)
    more = docs
    for c in ("did", "th", "tag", "set", "root", "n", "number", "taken", "size", "row", "spans", "kept", "length", "piece", "rank", "lang_pred", "score"):
        more = more.withColumn(c, F.lit("clash"))
    for name, stage in P.STAGES:
        got, want = stage(spark, more, ""), stage(spark, docs, "")
        assert got.columns == want.columns and (name == "packing" or got.columns == list(P.COLUMNS)), name
        if name == "packing":
            got, want = (d.drop("sequence_id", "offset") for d in (got, want))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), name
