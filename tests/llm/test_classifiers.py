import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemesh.llm import language, quality_model, toxicity
from tidemesh.llm.labelled import sample

from tests.llm.conftest import awkward, make

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_documents(tables):
    docs, _ = tables
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95


def test_language_never_reads_held_out_labels(spark, tables):
    docs, _ = tables
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("?"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_language_backs_off_for_unseen_words():
    texts = pa.array(["the thing that is there"] * 5 + ["der schnee der schule"] * 5, type=pa.large_string())
    m = language.Model(texts, ["en"] * 5 + ["de"] * 5)
    best, score = m.predict(pa.array(["schxx", "thxx", "123", "…", "日本", ""], type=pa.large_string()))
    assert [m.langs[i] if i >= 0 else None for i in best[:2]] == ["de", "en"]
    assert best[2:].tolist() == [-1, -1, best[4], -1] and best[4] >= 0 and score[2] == 0


def test_quality_and_toxicity_of_held_out_documents(tables):
    docs, labels = tables
    for got, label, k, v, least in ((quality_model.score(docs, labels), "quality", 5, 0, 0.93), (toxicity.score(docs, labels), "toxic", 4, 2, 0.88)):
        rows = got.join(labels, "doc_id").filter("held_out").collect()
        assert got.count() == docs.count() and all(fold(r.doc_id, k) == v and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert np.mean([r.predicted == r[label] for r in rows]) > least


def biased(n=800, seed=0):
    """Texts in which a group is mostly named along with insults, of which many occur nowhere else."""
    r = np.random.default_rng(seed)
    filler = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        insult = f"q{i}q" if i % 16 == 0 else str(r.choice(["scum", "vermin", "trash", "filth"]))
        words = [*r.choice(filler, 12), *([insult] if toxic else [])]
        if i % 8 == 0 or i % 80 == 1:
            words.insert(3, "muslims")
        elif i % 20 == 2:
            words.insert(3, "christians")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return pa.array(texts, type=pa.large_string()), labels


def test_neutral_mentions_of_a_group_are_no_false_alarms():
    """With the penalty as shipped."""
    texts, labels = biased()
    r = np.random.default_rng(9)
    groups = [g for terms in toxicity.IDENTITY for g in terms]
    neutral = pa.array([f"{t.as_py().replace(' muslims', '').replace(' christians', '')} {r.choice(groups) if i % 2 else 'muslims'}" for i, t in enumerate(texts) if not labels[i]], type=pa.large_string())
    alarms, gap = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        m = toxicity.Model(texts, labels, penalty=penalty)
        alarms[penalty] = int((m.score(neutral) >= 0.3).sum())
        gap[penalty] = float(np.ptp(m.score(pa.array([f"we met the {g} of the town" for g in ("muslims", "christians", "jews")], type=pa.large_string()))))
        assert (m.swaps > 0) == (penalty > 0)
        found = m.score(texts) >= 0.3
        assert np.mean(found[[i for i in range(len(labels)) if labels[i] and i % 16]]) > 0.95
    assert alarms[0.0] > 100 and alarms[toxicity.PENALTY] < 0.1 * alarms[0.0]
    assert gap[toxicity.PENALTY] < 0.3 * gap[0.0]


def test_swaps_are_fitted_on_texts_without_identity_terms(tables):
    docs, labels = tables
    texts, known = sample(docs, labels.filter("toxic IS NOT NULL").selectExpr("doc_id", "toxic AS label"))
    assert toxicity.Model(texts, known).swaps > 1000


def test_words_in_like_contexts_form_groups():
    r = np.random.default_rng(1)
    texts = [" ".join(["at", str(r.choice(["red", "blue"])), "house", "they", str(r.choice(["sang", "danced"])), "loud", *(["fool"] if i % 4 == 0 else [])]) for i in range(200)]
    groups = toxicity.alike(pa.array(texts, type=pa.large_string()), np.array([float(i % 4 == 0) for i in range(200)]))
    names = {int(h): w for w, (h, _) in ((w, (toxicity.features_of([w])[0][0], 0)) for w in ("red", "blue", "sang", "danced", "fool"))}
    found = [{names[int(h)] for h in g if int(h) in names} for g in groups]
    assert {"red", "blue"} in found and {"sang", "danced"} in found and not any("fool" in g for g in found)


def test_awkward_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(awkward()))] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for d, n in ((docs.withColumn("score", F.lit("x")), len(awkward())), (make(spark, []), 0), (make(spark, ["a b"] * 2, ids=[1, 1]), 2)):
        for lab in (labels, none):
            assert language.identify(d).count() == n
            for got in (quality_model.score(d, lab).collect(), toxicity.score(d, lab).collect()):
                assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3))


def test_sample_is_bounded(spark, docs):
    labels = docs.selectExpr("doc_id", "1 AS label")
    assert len(sample(docs, labels, most_docs=3)[0]) <= 3
    texts, _ = sample(docs, labels, most_bytes=2000)
    assert 0 < sum(len(t.as_py().encode()) for t in texts) <= 2000
    again = docs.withColumn("doc_id", F.lit(7)).union(docs)
    assert len(sample(again, labels.filter("doc_id = 7"))[0]) == 1


def test_null_texts_do_not_use_up_the_sample(spark, docs):
    nulls = make(spark, [None] * 50, ids=list(range(1000, 1050)))
    labels = docs.union(nulls).selectExpr("doc_id", "1 AS label")
    assert len(sample(docs.union(nulls), labels, most_docs=5)[0]) == 5


def test_scores_equal_plain_loops(tables):
    """Each model against a text-by-text, word-by-word version of its scoring."""
    docs, labels = tables
    texts, known = sample(docs, labels.filter("quality IS NOT NULL").selectExpr("doc_id", "quality AS label"))
    some = pa.array([*awkward()[1:], *(t.as_py() for t in texts[:40])], type=pa.large_string())
    m = quality_model.Model(texts, known)
    for (bucket, weight), got in zip(quality_model.bags(some), m.score(some), strict=True):
        z = sum(w * m.share[b] for b, w in zip(bucket.tolist(), weight.tolist(), strict=True)) + m.bias
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    texts, known = sample(docs, labels.filter("toxic IS NOT NULL").selectExpr("doc_id", "toxic AS label"))
    m = toxicity.Model(texts, known)
    value = dict(zip(m.table.hashes.tolist(), m.table.values.tolist(), strict=True))
    for i, got in enumerate(m.score(some)):
        z = m.bias + sum(value.get(h, 0.0) for h in set(toxicity.pairs_of(some.slice(i, 1))[1].tolist()))
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_language_equals_plain_loops():
    r = np.random.default_rng(2)
    word = lambda letters: "".join(r.choice(list(letters), r.integers(2, 7)))
    by = {"xx": "abcdef", "yy": "defghi", "zz": "ghiabc"}
    known = {lang: [word(by[lang]) for _ in range(150)] for lang in by}
    langs = [lang for lang in by for _ in range(40)]
    texts = [" ".join(r.choice(known[lang], 30)) for lang in langs]
    m = language.Model(pa.array(texts, type=pa.large_string()), langs)
    asked = [" ".join([word("abcdefghi") for _ in range(r.integers(1, 60))] + list(r.choice(known["yy"], r.integers(0, 9)))) for _ in range(60)]
    from tidemesh.llm.subwords import Distinct

    def value(w):
        d = Distinct(pa.array([w], type=pa.large_string()), parts=True)
        (row,) = m.tables[0].find(d.hashes)
        if row >= 0:
            return m.tables[0].values[row]
        for k in range(language.LONGEST, 0, -1):
            rows = m.tables[k].find(d.grams(k)[0])
            if (rows >= 0).any():
                return m.tables[k].values[rows[rows >= 0]].mean(0)
        return np.zeros(len(m.langs))

    best, score = m.predict(pa.array(asked, type=pa.large_string()))
    for i, t in enumerate(asked):
        total = sum(value(w) for w in t.split()) * min(len(t.split()), language.SURE) / len(t.split())
        p = np.exp(total - total.max())
        assert best[i] == p.argmax() and score[i] == pytest.approx(p.max() / p.sum(), abs=1e-9)


def test_language_ties_go_to_the_first_name():
    m = language.Model(pa.array(["aa aa", "aa aa"], type=pa.large_string()), ["yy", "xx"])
    best, score = m.predict(pa.array(["aa aa", "bb"], type=pa.large_string()))
    assert [m.langs[i] for i in best] == ["xx", "xx"] and score.tolist() == [0.5, 0.5]
