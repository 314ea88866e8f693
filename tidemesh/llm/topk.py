"""Exact top-k inner products by elimination with a table of pivot distances.

For a query q, a candidate x and any pivot p, |d(q, p) - d(x, p)| is a lower bound of d(q, x); the largest over
all pivots gives the upper bound (|q|^2 + |x|^2 - bound^2) / 2 of the inner product. Candidates are evaluated in
the order of that bound until the k-th best score found exceeds the next one: no candidate that is left can
change the result. The origin is one pivot (its bound is that of Cauchy and Schwarz), the others are spread
over a bounded sample; they decide how much is skipped, never the result.

Queries come in blocks of bounded size, which are broadcast; each task keeps the k best of its rows for each
query of the block, and the tasks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.llm.store import stored

SCALE = 1024
PIVOTS = 24
SAMPLE = 2048
#: Queries broadcast at once, about.
QUERIES = 8192
#: Candidates taken from the bound's order at a time.
STEP = 512


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def whole(columns: pa.Array | list, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, which is a whole number; missing components are 0."""
    lists = columns if isinstance(columns, pa.Array) else pa.array(columns, type=pa.list_(pa.float64()))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """The origin, and then each time the point farthest from those taken."""
    taken = [np.zeros(points.shape[1])]
    near = np.full(len(points), np.inf)
    while len(points) and len(taken) < most:
        near = np.minimum(near, ((points - taken[-1]) ** 2).sum(1))
        if near.max() <= 0:
            break
        taken.append(points[near.argmax()])
    return np.array(taken)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole inner products; doubles hold them exactly below 2 ** 53, 64-bit integers below 2 ** 63, else Python's integers are used."""
    most = len(q) * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(abs(score) >= 2**63 for score in out):
        raise OverflowError("a score of vectors this large doesn't fit into 64 bits")
    return np.array(out, dtype=np.int64)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.pivots, self.k = ids, queries, pivots, k
        self.table = distances(queries, pivots)
        self.square = (queries**2).sum(1)
        self.found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(ids)
        self.evaluated = 0

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids):
            return
        table, square = distances(x, self.pivots), (x**2).sum(1)
        for i, q in enumerate(self.queries):
            low = np.abs(table - self.table[i]).max(1)
            # A little above the true bound, for the rounding of the distances.
            size = self.square[i] + square
            bound = (size - low**2) / 2 + 1e-9 * size + 1
            score, who = self.found[i]
            order = np.flatnonzero(bound >= score[-1]) if len(score) == self.k else np.arange(len(bound))
            order = order[np.argsort(-bound[order], kind="stable")]
            for at in range(0, len(order), STEP):
                if len(score) == self.k and bound[order[at]] < score[-1]:
                    break
                some = order[at : at + STEP]
                some = some[ids[some] != self.ids[i]]
                self.evaluated += len(some)
                score, who = np.concatenate([score, exact(x[some], q)]), np.concatenate([who, ids[some]])
                first = np.lexsort((who, -score))[: self.k]
                score, who = score[first], who[first]
            self.found[i] = score, who


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id is divisible by ``every``.

    Null vectors and those with null or non-finite components take no part, nor do rows without an id; shorter vectors
    count as if they ended in zeros. Rows with a query's own id are no candidates of it; a query id with several vectors
    asks with the smallest. Ties go to the smaller vec_id. Other columns are ignored; without queries or other rows the result is empty.
    A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").collect()
    pivots = spread(whole([r[0] for r in sample], width), PIVOTS)
    blocks = max(1, -(-n // QUERIES))
    parts = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), whole([r[1] for r in block], width), pivots))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    best.offer(part.column(0).to_numpy(zero_copy_only=False), whole(part.column(1), width))
            own = np.repeat(best.ids, [len(s) for s, _ in best.found])
            if len(own):
                score, who = (np.concatenate(c) for c in zip(*best.found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        part = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(part if blocks == 1 else stored(part, "topk"))
        if blocks > 1:
            shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
