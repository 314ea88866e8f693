"""Best-fit packing of tokenised documents, with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How full sequences can get depends only on the
pieces' lengths, so the packing is found on the histogram of lengths (``capacity`` rows at most) on the
driver, as patterns with a multiplicity. Dominance first fixes the sets that some optimal packing holds: a
longest piece whose best partner fills the sequence, or which takes no two further pieces. That repeats on
the smaller instance; what no rule fixes is packed by best-fit decreasing. The pieces then find their
place through their rank among those of equal length, counted in hash buckets and chunks of these, so that no length has to meet in one task.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.ranks import before
from tidemesh.llm.store import stored

CAPACITY = 2048
END = 0
BUCKET_ROWS = 256
#: Parts of words whose ids a Python worker keeps between batches.
CACHE_WORDS = 1_000_000
BLOCK_BYTES = 1 << 20

_tokenizers: dict[str, object] = {}
_caches: dict[str, Cache] = {}


class Cache:
    """Ids of parts of words by their 64-bit hash, as sorted arrays: about 40 bytes for each."""

    def __init__(self) -> None:
        self.hashes, self.begin = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.length, self.uses = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.flat = np.empty(0, dtype="<u4")

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        return np.flatnonzero(at == len(self.hashes)) if not len(self.hashes) else np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes)

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        length = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        begin = len(self.flat) + np.cumsum(length) - length
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=int(length.sum()))])
        self.hashes, self.begin = np.insert(self.hashes, at, hashes[order]), np.insert(self.begin, at, begin[order])
        self.length, self.uses = np.insert(self.length, at, length[order]), np.insert(self.uses, at, 0)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin in flat, length) of parts that are there."""
        at = np.searchsorted(self.hashes, hashes)
        self.uses[at] += 1
        return self.begin[at], self.length[at].astype(np.int64)

    def shrink(self, most: int) -> None:
        """Keeps the most used half where there are too many."""
        if len(self.hashes) <= most:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: most // 2])
        length = self.length[keep].astype(np.int64)
        ends = np.cumsum(length)
        self.flat = self.flat[np.repeat(self.begin[keep] - (ends - length), length) + np.arange(ends[-1])]
        self.hashes, self.begin, self.length, self.uses = self.hashes[keep], ends - length, self.length[keep], self.uses[keep] // 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    """The tokenizer of a file, once in a process. It works on the task's own core: its threads would spin on those of other tasks."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def token_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a block, where each text's begin), as encode(text, add_special_tokens=False).

    The vocabulary's pre-tokens span neither white space nor the bound between an ASCII letter and an ASCII sign other
    than an apostrophe, and its normaliser makes letters small, so a text's ids are those of such parts of words in
    order; each distinct part is encoded once. Texts that may hold the string of a special token are encoded whole.
    """
    tok = _tokenizer(path)
    w = K.Words(text, parts=True)
    back, distinct = pd.factorize(w.hashes())
    cache = _caches.setdefault(path, Cache())
    cache.shrink(CACHE_WORDS)
    missing = cache.missing(distinct)
    if len(missing):
        at = np.empty(len(distinct), dtype=np.int64)
        at[back[::-1]] = np.arange(len(back))[::-1]
        raw, at = w.data.tobytes(), at[missing]
        words = [raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
        ids = [e.ids for i in range(0, len(words), 4096) for e in tok.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        cache.add(distinct[missing], ids)
    begins, lengths = cache.places(distinct)
    flat = cache.flat
    each = lengths[back]
    ends = np.cumsum(each)
    ids = flat[np.repeat(begins[back] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends])[w.first]
    special = [i for i, t in enumerate(text.to_pylist()) if "<|" in t]
    if special:
        rows = [ids[offsets[i] : offsets[i + 1]] for i in range(len(text))]
        for i in special:
            rows[i] = np.array(tok.encode(text[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        ids = np.concatenate(rows)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return ids, offsets


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch, most=BLOCK_BYTES):
                ids, offsets = token_ids(text, path)
                lengths = np.diff(offsets) + 1
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, lengths[doc] - start)
                little, zero = ids.astype("<u4"), np.array([END], dtype="<u4").tobytes()
                crc = []
                for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                    begin, end = offsets[d] + s, offsets[d + 1]
                    c = zlib.crc32(little[begin : min(begin + k, end)].tobytes())
                    crc.append(zlib.crc32(zero, c) if begin + k > end else c)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packs counts[length] pieces of each length: (lengths in a sequence, number of such sequences)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        out.append((lengths, n))
        for length in lengths:
            left[length] -= n

    # Dominance. Longest pieces first; each rule holds for all pieces of a length at once.
    for big in range(capacity, 0, -1):
        while left[big]:
            room = capacity - big
            present = np.flatnonzero(left[: room + 1])
            if not len(present):  # nothing fits beside it
                fix((big,), int(left[big]))
                continue
            least, best = int(present[0]), int(present[-1])
            second = least if left[least] > (2 if least == big else 1) else int(present[1]) if len(present) > 1 else None
            pair_fits = second is not None and least + second <= room
            if best == big:
                if best != room and pair_fits:
                    break
                if left[big] < 2:
                    if len(present) > 1 and least + (second or 0) > room:
                        fix((big, int(present[-2])), 1)
                        continue
                    break
                fix((big, big), int(left[big] // 2))
            elif best == room or not pair_fits:
                # One further piece at most fits, or the best fills the sequence: no set beats {big, best}.
                few = int(min(left[big], left[best]))
                if best != room and 2 * least <= room:
                    few = min(few, 1)
                fix((big, best), few)
            else:
                break
        # A length that isn't dominated stays; shorter ones are tried all the same, as exact pairs among them dominate too.
        room = capacity - big
        if left[big] and room > 0 and left[room] and room != big:
            fix((big, room), int(min(left[big], left[room])))
    # Best fit decreasing on what is left. open: room -> {pattern: sequences}
    opened: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                pattern, have = next(iter(opened[room].items()))
                # A sequence may take several of this length in a row only if no tighter room is opened by that; one at a time keeps best fit.
                take = min(n, have)
                if take == have:
                    del opened[room][pattern]
                    if not opened[room]:
                        rooms[room] = False
                else:
                    opened[room][pattern] = have - take
                key, rest = (*pattern, length), room - length
            else:
                per = capacity // length
                take, several = (n // per, per) if n >= per else (1, n)
                key, rest = (length,) * several, capacity - length * several
                n -= take * (several - 1)
            opened.setdefault(rest, {})
            opened[rest][key] = opened[rest].get(key, 0) + take
            rooms[rest] = rest > 0
            n -= take
    out += [(p, n) for by in opened.values() for p, n in by.items()]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A document's ids are its text's and the end id, so null and empty texts make a piece of one. Rows with the same
    doc_id are documents of their own, a null doc_id is kept; other columns are ignored, whatever their names; of an empty table
    the result is empty. A text is encoded whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    # Numbers that tell equal pieces apart, so that they can be dealt out like any others.
    pieces = stored(cut(docs, capacity, path).withColumn("number", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    # Slots: in a pattern of n sequences numbered from ``first``, ranks [low, low + n) of a length lie at ``offset``.
    used: dict[int, int] = {}
    slots, first = [], 0
    for lengths, n in patterns(counts, capacity):
        at = 0
        for length in lengths:
            low = used.get(length, 0)
            slots.append((length, low, low + n, first, at))
            used[length] = low + n
            at += length
        first += n
    assert used == counts, "the patterns don't hold each piece once"
    buckets = spark.createDataFrame([(k, max(1, v // BUCKET_ROWS)) for k, v in counts.items()], "length long, n_buckets long")
    key = F.xxhash64("number")
    placed = pieces.join(F.broadcast(buckets), "length").withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.col("n_buckets")))
    below = before(placed.groupBy("length", "bucket").count(), "length", "bucket", {"count": "below"})
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("number")) - 1
    ranked = placed.withColumn("within", within).join(below, ["length", "bucket"]).withColumn("rank", F.col("below") + F.col("within")).drop("key", "bucket", "n_buckets", "below", "within", "number")
    return _seated(ranked, slots)


def _seated(ranked: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks up each (length, rank) among the slots, which are sorted arrays of a size that depends on the capacity alone."""
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, low, _, first, at in slots:
        by_length.setdefault(length, []).append((low, first, at))
    tables = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by_length.items()}
    shared = ranked.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length):
                low, first, at = shared.value[int(k)]
                mine = np.flatnonzero(length == k)
                slot = np.searchsorted(low, rank[mine], side="right") - 1
                sequence[mine] = first[slot] + rank[mine] - low[slot]
                offset[mine] = at[slot]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
