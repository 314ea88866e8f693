import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemesh.llm import spans, substring_dedup, suffix_dedup

from tests.llm.conftest import awkward, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(texts, n):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, n):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if least[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed=1):
    """Texts that share passages at many lengths around the bound, with periodic and copied ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(160)]
    texts = list(awkward())
    for _ in range(60):
        a = r.randint(0, 100)
        cut = passage[a : a + r.randint(35, 70)]
        texts.append(" ".join([word() for _ in range(r.randint(0, 40))] + cut + [word() for _ in range(r.randint(0, 40))] + (cut if r.random() < 0.2 else [])))
    texts += ["xy" * 300, "xy" * 150 + "z" * 250, "a b " * 90, "a b c " * 70, " ".join(passage), " ".join(passage), "é" * 150]
    return texts


@pytest.mark.parametrize(("group", "ids"), [(4096, 100), (0, 0), (2, 100)])
def test_bytes_equal_brute_force(spark, monkeypatch, group, ids):
    monkeypatch.setattr(spans, "GROUP", group)
    monkeypatch.setattr(spans, "BROADCAST_IDS", ids)
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(make(spark, texts).repartition(4)).collect()}
    want = brute_bytes(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(("shift", "group", "ids"), [(1, 4096, 1000), (-1, 0, 0), (-1, 2, 1000)])
def test_words_equal_brute_force(spark, monkeypatch, shift, group, ids):
    monkeypatch.setattr(spans, "GROUP", group)
    monkeypatch.setattr(spans, "BROADCAST_IDS", ids)
    texts = corpus(2)
    rows = [(shift * i, t) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(make(spark, texts, ids=[i for i, _ in rows]).repartition(4)).collect())
    assert got == sorted(brute_words(rows, 50))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(80))
    d = make(spark, [t, t, t, "x"], ids=[1, 1, None, None]).withColumn("spans", F.lit(1)).withColumn("did", F.lit("x")).withColumn("n_removed", F.lit(2))
    got = suffix_dedup.dedup(d).collect()
    assert sorted(r.n_removed for r in got) == [0, len(t), len(t), len(t)] and len(got) == 4
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.dedup(d).collect()}
    assert got == {(1, 80): 0, (None, 80): 80, (None, 1): 0}


def test_empty_tables(spark):
    assert suffix_dedup.dedup(make(spark, [])).count() == 0
    assert substring_dedup.dedup(make(spark, [])).count() == 0


def thue_morse(n):
    """Two different strings that polynomial hashes modulo a power of two can't tell apart."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n], t[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse(spark, n):
    texts = [x for t in thue_morse(n) for x in (t, " ".join(t))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(make(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == brute_bytes(texts, 200)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(make(spark, texts)).collect())
    assert got == sorted(brute_words(list(enumerate(texts)), 50))


def test_many_rows_without_an_id(spark):
    """14,000 rows share the null id: each one loses what its own text repeats."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefghij ") for _ in range(260))
    texts = [f"{i} " + "".join(r.choice("klmnop ") for _ in range(30)) + (passage if i % 2000 == 0 else "") for i in range(14_000)]
    got = sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(make(spark, texts, ids=[None] * len(texts))).collect())
    assert got == sorted(brute_bytes(texts, 200))


def test_a_text_longer_than_a_block(spark):
    r = random.Random(6)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(200_000)]
    long_ = " ".join(words)
    assert len(long_) > 1 << 20
    texts = [" ".join(words[500:600]), long_, " ".join(words[-80:])]
    got = {x.doc_id: x.n_removed for x in substring_dedup.dedup(make(spark, texts)).collect()}
    assert got == {0: 0, 1: 100, 2: 80}
    got = {x.doc_id: x.n_removed for x in suffix_dedup.dedup(make(spark, texts)).collect()}
    assert got[0] == len(texts[0]) and got[2] == len(texts[2]) and got[1] >= len(texts[0]) + len(texts[2])


def test_corpus_order_is_that_of_the_suffixes():
    """Suffixes of one trigger stand in the order of their bytes, and neighbours have in common what a plain comparison finds."""
    r = random.Random(7)
    length, k = 30, 6
    tail = bytes(r.choice(b"abc\x00") for _ in range(60))
    cuts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(3, 20))) + tail[: r.randint(30, 60)] for _ in range(60)] + [b"ab" * 40]
    import pyarrow as pa

    row, at, before, after = suffix_dedup.corpus_order(pa.array(cuts, type=pa.binary()), length, k, 4)
    windows = [cuts[i][j : j + length] for i, j in zip(row.tolist(), at.tolist(), strict=True)]
    times = Counter(c[j : j + length] for c in cuts for j in range(len(c) - length + 1))
    assert sorted(windows) == sorted(w for w, n in times.items() if n > 1 for _ in range(n))
    assert all(max(x, y) >= length for x, y in zip(before.tolist(), after.tolist(), strict=True))
    # Equal windows are neighbours.
    assert len(set(windows)) == 1 + sum(x != y for x, y in zip(windows, windows[1:], strict=False))


def test_orders_are_those_of_the_bytes():
    import numpy as np

    r = random.Random(8)
    words = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 40))) for _ in range(50)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    rank = suffix_dedup.dictionary_order(data, np.repeat(first + size, size))
    suffixes = [w[i:] for w in words for i in range(len(w))]
    assert [sorted(set(suffixes)).index(x) for x in suffixes] == [sorted(set(rank.tolist())).index(x) for x in rank.tolist()]
    rank, common = suffix_dedup.parse_order(data, first, size, 40)
    in_order = [words[i] for i in np.argsort(rank)]
    assert in_order == sorted(words)
    assert common[1:].tolist() == [next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))) for x, y in zip(in_order, in_order[1:], strict=False)]


@pytest.mark.parametrize("modulus", [4, 30])
def test_anchors_are_the_first_trigger_or_the_least_hash(modulus):
    import numpy as np
    from tidemesh.llm import kernel as K

    rolling = K.Rolling(K.byte_codes(np.random.default_rng(3).integers(97, 100, 4000).astype(np.uint8)), 0)
    grams, place = spans.anchor_places(rolling, 40, 6, modulus)
    assert len(place) == 4000 - 40 + 1
    for x in range(len(place)):
        inside = grams[x : x + 35]
        hit = np.flatnonzero(inside >> np.uint64(32) < np.uint64((1 << 32) // modulus))
        assert place[x] == x + (hit[0] if len(hit) else K.last_minimum(inside, 35)[0])


def test_factors_grow_to_where_texts_part():
    import numpy as np
    import pyarrow as pa

    w = [f"v{i}" for i in range(200)]
    other = [f"x{i}" for i in range(40)]
    rows = [w[:90], w[60:150], w[10:130] + other]
    block = substring_dedup.Block(np.zeros(3, dtype=np.int64), np.array([1, 2, 3]), pa.array([" ".join(x).encode() for x in rows], type=pa.binary()), 20)
    row, at, size = substring_dedup.factors(block)
    # The second row agrees with the first on 30 words; the third with the first on 80 and, over that bound, with the second on the rest.
    assert list(zip(row.tolist(), at.tolist(), size.tolist(), strict=True)) == [(1, 0, 30), (2, 0, 80), (2, 61, 59)]
