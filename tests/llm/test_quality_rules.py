import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tidemesh.llm import quality_rules

from tests.llm.conftest import awkward, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(awkward())
    for i, t in enumerate(awkward()):
        want = brute(t)
        assert got[i][:5] == want, i
        assert got[i][5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i][5] and got[i][6])


def test_empty_table(spark):
    assert quality_rules.judge(make(spark, [])).count() == 0


def test_extra_columns_and_repeated_rows(spark):
    d = make(spark, ["some words here"] * 3, ids=[1, 1, 2]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    assert sorted(r.doc_id for r in quality_rules.judge(d).collect()) == [1, 1, 2]


def test_em_finds_how_far_rules_can_be_trusted():
    r = np.random.default_rng(0)
    n = 20000
    good = r.random(n) < 0.8
    alarm, detect = np.array([0.01, 0.02, 0.03, 0.15]), np.array([0.8, 0.7, 0.6, 0.2])
    against = r.random((n, 4)) < np.where(good[:, None], alarm, detect)
    votes = np.where(against, -1.0, 1.0) * (r.random((n, 4)) < 0.9)
    pattern, back, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fitted = quality_rules.fit(pattern, count.astype(float))
    assert abs(fitted[0] - 0.8) < 0.15 and (fitted[2] > fitted[1]).all()
    assert fitted[1].argmax() == 3
    assert ((quality_rules.posterior(pattern, *fitted)[back.ravel()] >= 0.5) == good).mean() > 0.9


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    kept = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.15


def test_a_corpus_of_mostly_junk(spark):
    """Four documents in five are bad."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality IS NOT NULL")
    bad = docs.filter("quality = 0")
    some = docs.filter("quality = 1").orderBy(F.xxhash64("doc_id")).limit(bad.count() // 4)
    got = quality_rules.judge(bad.union(some)).join(docs.select("doc_id", "quality"), "doc_id").filter("NOT base_failed")
    kept = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_em_where_most_documents_are_bad():
    r = np.random.default_rng(4)
    n = 20000
    good = r.random(n) < 0.2
    alarm, detect = np.array([0.01, 0.02, 0.03, 0.02]), np.array([0.8, 0.7, 0.6, 0.5])
    against = r.random((n, 4)) < np.where(good[:, None], alarm, detect)
    pattern, back, count = np.unique(np.where(against, -1.0, 1.0), axis=0, return_inverse=True, return_counts=True)
    fitted = quality_rules.fit(pattern, count.astype(float))
    assert abs(fitted[0] - 0.2) < 0.1
    assert ((quality_rules.posterior(pattern, *fitted)[back.ravel()] >= 0.5) == good).mean() > 0.95


def test_lines_that_polynomial_hashes_confuse():
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        other = t[:n].translate(str.maketrans("ab", "ba"))
        counts = quality_rules.text_counts(pa.array([f"{t[:n]}\n{other}", f"{t[:n]}\n{t[:n]}"], type=pa.large_string()))
        assert counts["n_dup_lines"].tolist() == [0, 1] and counts["n_distinct_words"].tolist() == [2, 1]
