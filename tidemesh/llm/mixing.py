"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal tokens. Slot i is given the golden-ratio point
frac(i * 0.618...), and the point's place among the sources' cumulative target shares names the
slot's source. Points of that sequence fall evenly at every length, so any stretch of the schedule
holds each source near its share. The r-th slot of a source takes block r of the source's stream: its
documents in shuffled order, gone through twice at most.

What a source gives is its quota, its target in whole words, whatever number of slots the schedule happens
to give it: the first quota words of its stream are cut into as many blocks as it has slots, equal
to a word. So a source's slots differ from the common length by what rounding its share to slots left over or
short. A source without any slot, but with a target, gets one of its own; these are spread over the schedule.

Nothing here needs a whole source in one task: slots are ranked in chunks, and documents are placed
in their source's stream by hash buckets, whose totals are summed first, in chunks as well (ranks.before()).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemesh.llm import kernel as K
from tidemesh.llm.ranks import before
from tidemesh.llm.store import nullable, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SLOTS = 1 << 18
#: Documents expected in a hash bucket of a source, and slots in a chunk of the schedule.
BUCKET_ROWS = 256
CHUNK_SLOTS = 4096
#: Sources a table may have; their totals are held on the driver.
MOST_SOURCES = 100_000


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, th (a hash of text and source), the columns ``keep`` and size (words ``[^\\x20\\x09-\\x0D]+``) of each document."""
    names = ["doc_id", "source", "th", *(f"_{c}" for c in keep)]
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(text, source).alias("th"), *(F.col(c).alias(f"_{c}") for c in keep), text.alias("text"))
    schema = T.StructType([*nullable(rows.schema).fields[:-1], T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in K.blocks(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(K.Words(text).counts.astype(np.int64))], names=[*names, "size"])

    return rows.mapInArrow(run, schema)


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> list[tuple[str | None, int, float]]:
    """(source, its size, its target), sources by code point with null last, weights repeating.

    A target stops at ``repeats`` times its source's size; the excess goes to the others by weight until none is above.
    """
    rows = [(s, n, w) for (s, n), w in zip(sorted(totals, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""])), cycle(weights), strict=False)]
    left, out = share * sum(n for _, n, _ in rows), {}
    open_rows = rows
    while open_rows:
        level = left / sum(w for *_, w in open_rows)
        full = [r for r in open_rows if level * r[2] >= repeats * r[1]]
        if not full:
            out |= {s: level * w for s, _, w in open_rows}
            break
        out |= {s: float(repeats * n) for s, n, _ in full}
        left -= sum(repeats * n for _, n, _ in full)
        open_rows = [r for r in open_rows if r[0] not in out]
    return [(s, n, out[s]) for s, n, _ in rows]


def quotas(goals: list[float]) -> list[int]:
    """Each target in whole words, together the targets' sum: the largest fractions are rounded up. No target above 0 becomes 0, even if that takes more words."""
    low = [max(int(t), t > 0) for t in goals]
    more = round(sum(goals)) - sum(low)
    for i in sorted((i for i, t in enumerate(goals) if t > low[i]), key=lambda i: (low[i] - goals[i], i))[: max(0, more)]:
        low[i] += 1
    return [int(q) for q in low]


def points(slot: np.ndarray) -> np.ndarray:
    """The golden-ratio points of slots, as 64-bit fractions."""
    return (slot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def schedule(spark, goals: list[float], slots: int) -> tuple[DataFrame, list[int]]:
    """(plan, each goal's number of slots). plan: slot, sid (place in goals), block (the slot's rank among its source's), one row for each slot.

    Goals above 0 that none of the ``slots`` points falls to have one slot more each; slots are numbered with these in between.
    """
    bounds = np.cumsum(goals)
    edges = np.minimum(bounds / max(bounds[-1], 1e-300) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    last = int(np.flatnonzero(np.array(goals) > 0)[-1])

    def owner(slot: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(edges, points(slot), side="right"), last)

    held = np.zeros(len(goals), dtype=np.int64)
    for at in range(0, slots, 1 << 16):
        held += np.bincount(owner(np.arange(at, min(at + (1 << 16), slots))), minlength=len(goals))
    without = np.flatnonzero((held == 0) & (np.array(goals) > 0))
    without = without[np.argsort(points(np.arange(len(without))))]
    #: How many of the points come before each slot that is added.
    ahead = (2 * np.arange(len(without)) + 1) * slots // max(1, 2 * len(without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            sid, number = owner(slot), slot + np.searchsorted(ahead, slot, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(sid), pa.array(slot // CHUNK_SLOTS)], names=["slot", "sid", "chunk"])

    plan = spark.range(0, slots, 1, max(1, slots // (16 * CHUNK_SLOTS))).mapInArrow(run, "slot long, sid long, chunk long")
    earlier = plan.groupBy("sid", "chunk").count().withColumn("before", F.sum("count").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1
    plan = plan.withColumn("within", within).join(earlier, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("within")).alias("block"))
    if len(without):
        added = zip((ahead + np.arange(len(without))).tolist(), without.tolist(), strict=True)
        plan = plan.union(spark.createDataFrame([(n, s, 0) for n, s in added], "slot long, sid long, block long"))
    held[without] = 1
    return plan, held.tolist()


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, slots: int = SLOTS, seed: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: doc_id, source, th, size, source_size, target, taken of every row of ``docs`` and its columns ``keep``; taken counts
    repeats; a source's sum of it is its target to a word.
    pieces: slot, place, doc_id, row, start, length: the words [start, start + length) of a document that the slot holds, in order of place.
    Null and empty texts have size 0 and are never taken. Null is a source of its own. Rows with the same doc_id are
    documents of their own; th, a hash of text and source, tells them apart, and where that is equal, only ``row``. A null doc_id is kept. Other columns are ignored, whatever their names. Of an empty table both results are empty. Equal inputs give equal mixes.
    A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes. Rows that are equal in id, text and
    source stand together in their source's stream, in one window.
    """
    spark = docs.sparkSession
    table = stored(sizes(docs, keep), "sizes")
    totals = table.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    goals = targets([(r["source"], r["n"]) for r in totals], weights, share, repeats)
    rows = {r["source"]: r["rows"] for r in totals}
    wanted = sum(t for *_, t in goals)
    block = max(1, round(wanted / slots))
    plan, held = schedule(spark, [t for *_, t in goals], max(1, round(wanted / block))) if wanted > 0 else (None, [0] * len(goals))
    quota = quotas([t for *_, t in goals])
    sources = spark.createDataFrame(
        [(i, s, n, t, max(1, rows[s] // BUCKET_ROWS), quota[i], quota[i] // max(1, held[i]), quota[i] % max(1, held[i])) for i, (s, n, t) in enumerate(goals)],
        "sid long, source string, source_size long, target double, n_buckets long, quota long, least long, longer long",
    )
    placed = table.join(F.broadcast(sources), table["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    key = F.xxhash64("doc_id", "size", "th", F.lit(seed))
    placed = placed.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.col("n_buckets")))
    in_bucket = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"), F.count(F.lit(1)).alias("bucket_rows"))
    in_bucket = before(in_bucket, "sid", "bucket", {"bucket_size": "base", "bucket_rows": "base_row"})
    order = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "th")
    placed = (
        placed.withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("inner_row", F.row_number().over(order))
        .join(in_bucket, ["sid", "bucket"])
        .withColumn("at", F.col("base") + F.col("inner"))
        .withColumn("row", F.col("base_row") + F.col("inner_row"))
    )
    kept = [F.col(f"_{c}").alias(c) for c in keep]
    if plan is None:
        empty = spark.createDataFrame([], "slot long, place long, doc_id long, row long, sid long, start long, length long")
        return placed.select("doc_id", "source", "th", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *kept), empty
    # Each pass of a document through the stream, up to the quota, cut at the blocks' bounds: a source's first ``longer`` blocks have a word more than ``least``.
    spans = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size"))
    spans = spans.filter("from < quota").withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    number = "if({0} < longer * (least + 1), {0} div (least + 1), longer + ({0} - longer * (least + 1)) div greatest(least, 1))"
    cut = spans.withColumn("block", F.explode(F.expr(f"sequence({number.format('from')}, {number.format('(to - 1)')})")))
    begin = F.expr("block * least + least(block, longer)")
    end = F.expr("(block + 1) * least + least(block + 1, longer)")
    low, high = F.greatest(F.col("from"), begin), F.least(F.col("to"), end)
    cut = cut.select("sid", "block", "doc_id", "row", (low - begin).alias("place"), (low - F.col("from")).alias("start"), (high - low).alias("length"))
    pieces = cut.join(plan, ["sid", "block"]).select("slot", "place", "doc_id", "row", "sid", "start", "length")
    taken = pieces.groupBy("sid", "row").agg(F.sum("length").alias("taken"))
    result = placed.join(taken, ["sid", "row"], "left").select("doc_id", "source", "th", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *kept)
    return result, pieces
