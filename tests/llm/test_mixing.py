from collections import defaultdict

import pytest
from tidemesh.llm import mixing

from tests.llm.conftest import SCHEMA, make


def test_targets_reshare_what_is_above_twice_the_size():
    got = mixing.targets([("b", 100), (None, 1000), ("a", 10)])
    assert [s for s, *_ in got] == ["a", "b", None]
    assert got[0][2] == 20 and got[1][2] == 200
    assert sum(t for *_, t in got) == pytest.approx(1.5 * 1110)


def test_mix_takes_each_sources_target(spark):
    rows = [(i, "w " * (i % 50), "en", f"s{i % 7}" if i % 3 else "hot", 0) for i in range(3000)] + [(5000, None, "en", None, 0), (5001, "x " * 40, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    result, pieces = mixing.mix(docs, slots=1 << 12)
    got = result.collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r["size"]
        assert r["size"] == (r.doc_id % 50 if r.doc_id < 5000 else 0 if r.doc_id == 5000 else 40)
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=60)
    assert sorted(r.taken for r in mixing.mix(docs, slots=1 << 12)[0].collect()) == sorted(r.taken for r in got)
    # The schedule is even: every eighth of it holds each source's share.
    total = sum(target.values())
    parts = pieces.selectExpr("slot div 512 AS part", "sid", "length").groupBy("part", "sid").sum("length").collect()
    ids = {s: i for i, s in enumerate(sorted(target, key=lambda s: (s is None, s)))}
    for s, i in ids.items():
        shares = [r[2] for r in parts if r["sid"] == i]
        assert max(shares) <= target[s] / total * 512 * round(total / 4096) + 60
    # A slot's pieces fill it without gaps.
    by_slot = defaultdict(list)
    for r in pieces.collect():
        by_slot[r.slot].append((r.place, r.length))
    for parts in by_slot.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n


def test_empty_and_textless_tables(spark):
    assert mixing.mix(make(spark, []))[0].count() == 0
    assert [r.taken for r in mixing.mix(make(spark, [None, ""]))[0].collect()] == [0, 0]


def test_repeated_rows(spark):
    got = mixing.mix(make(spark, ["a b c"] * 4, ids=[1, 1, 1, 2]))[0].collect()
    assert sum(r.taken for r in got) == pytest.approx(18, abs=2) and len(got) == 4


def test_every_source_takes_its_target_to_a_word(spark):
    rows = [(i, "w " * 40, "en", f"large{i % 3}", 0) for i in range(900)] + [(10_000 + i, "v " * (1 + i % 9), "en", f"small{i // 2:03}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    result, pieces = mixing.mix(docs, slots=64)
    taken, target = defaultdict(int), {}
    for r in result.collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(t > 0 for t in target.values())
    for s, t in target.items():
        assert taken[s] > 0 and abs(taken[s] - t) < 1, s
    assert sum(taken.values()) == round(sum(target.values()))
    # A slot is one source's, its pieces leave no gaps, and no stretch of the schedule is left to the small sources.
    by_slot, sids = defaultdict(list), defaultdict(set)
    for r in pieces.collect():
        by_slot[r.slot].append((r.place, r.length))
        sids[r.slot].add(r.sid)
    for slot, parts in by_slot.items():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert len(sids[slot]) == 1
    assert sorted(by_slot) == list(range(len(by_slot)))
    words = [sum(n for _, n in by_slot[s]) for s in sorted(by_slot)]
    eighth = len(words) // 8
    assert min(sum(words[k * eighth : (k + 1) * eighth]) for k in range(8)) > sum(words) / 16


def test_quotas():
    assert mixing.quotas([2.0, 1.5, 0.25, 0.0]) == [2, 1, 1, 0]
    assert mixing.quotas([3.4, 3.4, 3.2]) == [4, 3, 3] and mixing.quotas([2.9999999, 3.0000001]) == [3, 3]
    assert mixing.quotas([0.2] * 5) == [1] * 5


def plain_mix(rows, keys, buckets, slots):
    """slot, doc_id, start, length of all pieces in order, by the words of the module's description and plain loops."""
    by_source = defaultdict(list)
    for (i, text, source), key in zip(rows, keys, strict=True):
        by_source[source].append((key, i, len((text or "").split())))
    goals = mixing.targets([(s, sum(n for *_, n in v)) for s, v in by_source.items()])
    quota = mixing.quotas([t for *_, t in goals])
    wanted = sum(t for *_, t in goals)
    block = max(1, round(wanted / slots))
    count = max(1, round(wanted / block))
    golden, bounds, total = 0x9E3779B97F4A7C15, [], 0.0
    for *_, t in goals:
        total += t
        bounds.append(total)
    owners = []
    for i in range(count):
        point = (i + 1) * golden % 2**64
        owners.append(next((k for k, b in enumerate(bounds) if point < min(int(b / total * 2.0**64), 2**64 - 2048)), len(goals) - 1))
    out = []
    for k, (source, _, _) in enumerate(goals):
        mine = [i for i, o in enumerate(owners) if o == k]
        n = buckets[source]
        stream = []
        for key, i, size in sorted(by_source[source], key=lambda r: ((r[0] % 2**64 >> 20) % n, r[0], r[1])):
            stream += [(i, w) for w in range(size)]
        stream = (stream * 2)[: quota[k]]
        least, longer = divmod(len(stream), len(mine))
        at = 0
        for r, slot in enumerate(mine):
            words = stream[at : at + least + (r < longer)]
            at += len(words)
            for j, (i, w) in enumerate(words):
                if j == 0 or w == 0 or words[j - 1] != (i, w - 1):
                    out.append([slot, i, w, 0])
                out[-1][3] += 1
    return sorted(map(tuple, out))


def test_equals_a_plain_schedule(spark):
    """The whole schedule and every block of it."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["hot", "b", "c", None][0 if i % 2 else i % 4]) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    for c in ("size", "th", "key", "bucket", "row", "sid", "taken"):
        docs = docs.withColumn(c, F.lit("clash"))
    sized = spark.createDataFrame([(i, t, s, len(t.split())) for i, t, s in rows], "doc_id long, text string, source string, size long")
    keys = {r[0]: r[1] for r in sized.select("doc_id", F.xxhash64("doc_id", "size", F.xxhash64("text", "source"), F.lit(1))).collect()}
    members = defaultdict(int)
    for *_, s in rows:
        members[s] += 1
    result, pieces = mixing.mix(docs, slots=1 << 10)
    got = sorted((r.slot, r.doc_id, r.start, r.length) for r in pieces.collect())
    want = plain_mix(rows, [keys[i] for i, *_ in rows], {s: max(1, n // mixing.BUCKET_ROWS) for s, n in members.items()}, 1 << 10)
    assert got == want
    taken = defaultdict(int)
    for _, i, _, n in want:
        taken[i] += n
    assert {r.doc_id: r.taken for r in result.collect()} == {i: taken[i] for i, *_ in rows}


def test_running_sums_in_chunks(spark):
    from tidemesh.llm.ranks import before

    rows = [(k, b, b % 5 + k) for k in (0, 1) for b in range(0, 60, 1 + k)]
    got = {(r.k, r.b): r.below for r in before(spark.createDataFrame(rows, "k long, b long, n long"), "k", "b", {"n": "below"}, chunk=7).collect()}
    assert got == {(k, b): sum(n for kk, bb, n in rows if kk == k and bb < b) for k, b, _ in rows}
