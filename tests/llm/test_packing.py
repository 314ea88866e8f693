import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tidemesh.llm import packing

from tests.llm.conftest import awkward, make


def best_fit(counts, capacity):
    bins = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            room = min((b for b in bins if b >= size), default=None)
            if room is not None:
                bins.remove(room)
            bins.append((capacity if room is None else room) - size)
    return len(bins)


def test_patterns_hold_each_piece_and_rival_best_fit():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([10, 20, 50, 100])
        counts = {r.randint(1, capacity): r.randint(1, 20) for _ in range(r.randint(1, 30))}
        used, bins = Counter(), 0
        for lengths, n in packing.patterns(counts, capacity):
            assert n > 0 and sum(lengths) <= capacity
            bins += n
            for x in lengths:
                used[x] += n
        assert used == Counter(counts)
        assert bins <= 1.03 * best_fit(counts, capacity) + 1


def test_dominance_reaches_the_optimum_where_rules_decide():
    assert sum(n for _, n in packing.patterns({7: 3, 3: 3, 6: 2, 4: 2, 10: 1}, 10)) == 6
    assert sum(n for _, n in packing.patterns({9: 5, 8: 2}, 10)) == 7


@pytest.mark.parametrize("text", ["a<|endoftext|>b c", "It's we'll don't ''s .'s x'y É é ǅ İ", "H̱ K̊ á .́ ≮x", "foo,bar$$$ (x) 12ab %%%", "a\u0085b　c…..", ""])
def test_ids_are_the_tokenizers(text):
    ids, offsets = packing.token_ids(pa.array([text, "and more", text], type=pa.large_string()), packing.vocabulary())
    want = packing._tokenizer(packing.vocabulary()).encode(text, add_special_tokens=False).ids
    assert ids[offsets[0] : offsets[1]].tolist() == want == ids[offsets[2] : offsets[3]].tolist()


def test_pack_round_trip(spark, docs):
    tok = packing._tokenizer(packing.vocabulary())
    rows = packing.pack(docs, capacity=256).collect()
    seen, filled = defaultdict(dict), defaultdict(list)
    for r in rows:
        seen[r.doc_id][r.piece] = r
        filled[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(awkward()):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        assert len(seen[i]) == -(-len(ids) // 256)
        for k, r in seen[i].items():
            part = ids[k * 256 : (k + 1) * 256]
            assert (r.start, r.length, r.ids_crc32) == (k * 256, len(part), zlib.crc32(part.tobytes()))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack(make(spark, [])).count() == 0
    assert sorted(r.offset for r in packing.pack(make(spark, [None] * 3, ids=[1, 1, 2])).collect()) == [0, 1, 2]


def test_words_that_polynomial_hashes_confuse():
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        pair = [t[:n], t[:n].translate(str.maketrans("ab", "ba"))]
        ids, offsets = packing.token_ids(pa.array([" ".join(pair), pair[1]], type=pa.large_string()), packing.vocabulary())
        tok = packing._tokenizer(packing.vocabulary())
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [tok.encode(x, add_special_tokens=False).ids for x in (" ".join(pair), pair[1])]


def test_clashing_columns_null_ids_and_many_equal_rows(spark):
    from pyspark.sql import functions as F

    d = make(spark, ["one two"] * 700 + [None], ids=[None] * 700 + [3])
    for c in ("piece", "start", "length", "ids_crc32", "rank", "number", "bucket", "offset"):
        d = d.withColumn(c, F.lit("x"))
    rows = packing.pack(d).collect()
    assert len(rows) == 701 and sum(r.doc_id is None for r in rows) == 700
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(filled) == -(-sum(r.length for r in rows) // packing.CAPACITY)
