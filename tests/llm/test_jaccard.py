import random
import re

from pyspark.sql import functions as F
from tidemesh.llm import jaccard

from tests.llm.conftest import awkward, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=3):
    """Groups of edited copies around the threshold, chains of them, shared passages, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéA") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = list(awkward()) + ["a b", "A B", "a b c", "a b c d e", "A b c d E", "", None]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 12, 30, 80, 200]))]
        if r.random() < 0.5:
            base[3:3] = passage
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if r.random() < 0.4:
                base = copy
    texts += [" ".join([word() for _ in range(n)] + passage + [word() for _ in range(m)]) for n, m in ((10, 10), (3, 4), (0, 5), (5, 0), (80, 1), (2, 3), (1, 1))]
    return texts


def test_equals_brute_force(spark):
    for seed in (3, 4):
        texts = corpus(seed)
        ids = [1000 - 7 * i for i in range(len(texts))]
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(make(spark, texts, ids=ids).repartition(4)).collect())
        assert got == brute(list(zip(ids, texts, strict=True)))


def test_all_pairs_that_a_pivot_does_not_link(spark):
    """A ring of copies in which only neighbours are similar enough."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * i : 8 * i + 100]) for i in range(30)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(make(spark, texts)).collect())
    assert got == brute(list(enumerate(texts)))
    assert {c for *_, c in got} == {0}


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    d = make(spark, ["a b c d e f", "a b c d e f", "x", None], ids=[None, 5, 5, None]).withColumn("token", F.lit(1)).withColumn("set", F.lit("s")).withColumn("n", F.lit(0))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 1, 5), (None, 0, None)], key=str)
    assert jaccard.join(make(spark, [])).count() == 0


def near_copies(seed, n):
    """One group of copies around the threshold: words replaced by others of a small vocabulary, words left out, ends cut off, a second version."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    second = list(base)
    for i in r.sample(range(120), 5):
        second[i] = f"second{i}"
    texts = [" ".join(base)]
    while len(texts) < n:
        copy = list(r.choice((base, base, second)))
        kind = r.random()
        if kind < 0.7:
            for _ in range(r.randint(0, 6)):
                i = r.randrange(len(copy))
                copy[i] = f"{copy[i]}x{r.randint(0, 3)}"
        elif kind < 0.85:
            for _ in range(r.randint(0, 5)):
                del copy[r.randrange(len(copy))]
        else:
            copy = copy[r.randint(0, 12) : len(copy) - r.randint(0, 40)]
        texts.append(" ".join(copy))
    return texts


def test_a_large_group_of_near_copies_around_the_threshold(spark):
    texts = near_copies(1, 1000)
    r = random.Random(2)
    ids = r.sample(range(10**6), len(texts))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(make(spark, texts, ids=ids).repartition(4)).collect())
    want = brute(list(zip(ids, texts, strict=True)))
    assert got == want
    assert 10 < len({c for *_, c in want}) < len(texts) - 100


def test_thue_morse(spark):
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    texts = [x for n in (1024, 2048) for x in (t[:n], t[:n].translate(str.maketrans("ab", "ba")))]
    texts += [" ".join(x) for x in texts]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(make(spark, texts)).collect())
    assert got == brute(list(enumerate(texts)))
