"""Entity operators on small tables."""

import pytest
from tidemesh.operators import entities, reads


def test_key_tree_of_any_depth(spark):
    keys = spark.createDataFrame([(i, f"k{i}", i - 1 if i else None) for i in range(36)], "id long, name string, parent_id long").coalesce(1).cache()
    got = {r.id: (r.depth, r.path) for r in entities.key_tree(keys).collect()}
    assert got == {i: (i, "/".join(f"k{j}" for j in range(i + 1))) for i in range(36)}


def test_key_tree_refuses_cycles(spark):
    keys = spark.createDataFrame([(1, "a", None), (2, "b", 1), (1, "c", 2)], "id long, name string, parent_id long")
    with pytest.raises(Exception, match="ancestor"):
        entities.key_tree(keys).collect()


def test_nested_copies_are_bounded_and_counted(spark):
    rows = [(i, 100.0 + i, f"h{i % 2}", 1, -50, 1.0) for i in range(41)]
    packets = spark.createDataFrame(rows, "id long, timestamp double, packet_hash string, type int, rssi int, snr double")
    got = {r.packet_hash: (r.id, r.duplicate_count, [d.id for d in r.duplicates]) for r in entities.duplicates_nested(packets, most=5).collect()}
    assert got == {"h0": (0, 20, [2, 4, 6, 8, 10]), "h1": (1, 19, [3, 5, 7, 9, 11])}


def test_nested_copies_are_whole(spark):
    rows = [(i, 100.0 + i // 7, f"h{i % 2}", 1, -50, 1.0) for i in range(5000)]
    packets = spark.createDataFrame(rows, "id long, timestamp double, packet_hash string, type int, rssi int, snr double")
    got = {r.packet_hash: (r.id, r.duplicate_count, [d.id for d in r.duplicates]) for r in entities.duplicates_nested(packets).collect()}
    assert got == {f"h{k}": (k, 2499, list(range(k + 2, 5000, 2))) for k in (0, 1)}


def test_nested_copies_without_time_or_hash(spark):
    rows = [(1, None, "h", 3), (2, 5.0, "h", 4), (3, 4.0, "h", 5), (4, 2.0, None, 6), (5, 1.0, None, 7), (6, 9.0, "alone", 8)]
    packets = spark.createDataFrame([(*r, -50, 1.0) for r in rows], "id long, timestamp double, packet_hash string, type int, rssi int, snr double")
    for most in (None, 2):
        got = {r.packet_hash: (r.id, r.type, r.duplicate_count, r.duplicates and [d.id for d in r.duplicates]) for r in entities.duplicates_nested(packets, most).collect()}
        assert got == {"h": (3, 5, 2, [2, 1]), None: (5, 7, 0, None), "alone": (6, 8, 0, None)}


def test_ring_without_time_or_hash(spark):
    rows = [(1, None, "h", 3), (2, 5.0, "h", 4), (3, None, "late", 5), (4, 2.0, None, 6), (5, 1.0, None, 7), (6, 9.0, "alone", 8)]
    packets = spark.createDataFrame([(*r, -50, 1.0) for r in rows], "id long, timestamp double, packet_hash string, type int, rssi int, snr double")
    assert [(r.id, r.packet_hash) for r in reads.recent_ring(packets).collect()] == [(6, "alone"), (2, "h"), (5, None), (3, "late")]
    assert [r.id for r in reads.recent_ring(packets, 2).collect()] == [6, 2]
