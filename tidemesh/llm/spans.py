"""Cutting a corpus into phrases by content, to find its repeated runs of L units (bytes or words) exactly and without an all-positions shuffle.

A window is a run of L units of one document. Its anchor is a k-gram inside it that is a function of the window alone, so equal
windows have equal anchors at the same place: the first k-gram whose rolling hash is 0 modulo a constant (a trigger), or,
without such a constant and in windows without a trigger, the one with the least rolling hash (the last of equals).
Neighbouring windows with one anchor form a phrase, of MOST windows at most, so there is one phrase for many units. With the
units after it that its last window reaches into, a phrase overlaps the next by L - 1 units, hence each window lies in exactly
one. In varied text a phrase's anchor has one place and its windows differ; where it has several (periodic
text), equal windows may lie in one phrase.

* Anchors that the corpus holds once, at one place, settle all their windows: none is repeated.
* Of the others, equal phrases (anchor and hash of the whole phrase, 124 bits) settle all their windows: each is repeated.
* Only distinct phrases that share an anchor have to be compared, once for each distinct phrase: the phrases of one anchor in
  one task (suffix_dedup.corpus_order(), substring_dedup.factors()), as long as there are at most GROUP of them, else by a
  shuffle of their windows' hashes.

Grouping uses counts and minima that combine before the shuffle; joins are on keys whose hot values Spark can split.
Rows are told apart by their doc_id and 87 bits of hashes of their text: rows with one doc_id and one text share their spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.store import scratch, stored

#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1
#: Windows in a phrase at most.
MOST = 255
#: Phrases of one anchor that are compared in one task at most.
GROUP = 2048
#: Ids that are broadcast to pick documents out before a shuffle; with more of them all are shuffled.
BROADCAST_IDS = 2_000_000
#: A row's key.
ROW = ["did", "th", "tag"]
_PHRASE = "anchor long, phrase long, did long, th long, loc long"
#: Gives, of cuttings sorted by anchor (anchor, phrase, did, cut), the places of each one's windows that count as repeated.
Judge = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


class Units:
    """Codes of a block's units, and where each text's begin."""

    def __init__(self, text: pa.Array, kind: str) -> None:
        """text: of large_string, or of large_binary as cut out of texts."""
        if kind == "bytes":
            self.data, self.first = K.buffers(text)
            self.codes = K.byte_codes(self.data)
        else:
            self.words = K.Words(text)
            self.codes, self.first = self.words.hashes(), self.words.first


def row_key() -> list[Column]:
    """ROW of documents: rows with equal keys are told apart by nothing, and need not be. Null and empty texts are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 41).alias("tag")]


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ROW, text and the columns ``keep`` of each row."""
    return docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(c for c in keep if c != "text"))


def anchor_places(rolling: K.Rolling, length: int, k: int, modulus: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-grams, place of each window's anchor)."""
    grams = rolling.grams(k)
    span = length - k + 1
    if not modulus:
        return grams, K.last_minimum(grams, span)
    n = max(len(grams) - span + 1, 0)
    # 0 modulo the constant, by the upper bits.
    triggers = np.flatnonzero(grams >> np.uint64(32) < np.uint64((1 << 32) // modulus))
    bounds = np.minimum(np.concatenate([[0], triggers + 1, [n]]), n)
    place = np.repeat(np.append(triggers, len(grams) + span), np.diff(bounds))
    without = np.flatnonzero(place >= np.arange(n) + span)
    # The grams of each run of windows without a trigger, one run after another.
    runs = np.flatnonzero(np.diff(without, prepend=-2) != 1)
    low, size = without[runs], np.diff(np.append(runs, len(without)))
    ends = np.cumsum(size + span - 1)
    at = np.repeat(low - (ends - size - span + 1), size + span - 1) + np.arange(ends[-1] if len(ends) else 0)
    if len(without):
        least = K.last_minimum(grams[at], span)
        place[without] = at[least[np.repeat((ends - size - span + 1) - (np.cumsum(size) - size), size) + np.arange(len(without))]]
    return grams, place


def phrases_of(units: Units, length: int, k: int, modulus: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, whether its anchor has several places, anchor, hash) of each phrase of a block."""
    codes, first = units.codes, units.first
    n = len(codes) - length + 1
    if n <= 0:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = K.Rolling(codes, K.BASES[0])
    grams, place = anchor_places(rolling, length, k, modulus)
    step = np.zeros(n + 1, dtype=np.int64)
    long_ = np.diff(first) >= length
    np.add.at(step, first[:-1][long_], 1)
    np.add.at(step, first[1:][long_] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    anchor = grams[place]
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & new)
    last = np.ones(n, dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    end = np.flatnonzero(valid & last) + 1
    # Long runs in pieces of MOST windows.
    pieces = -(-(end - start) // MOST)
    whole = np.repeat(np.arange(len(start)), pieces)
    start = start[whole] + MOST * (np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + MOST, end[whole])
    several = (place[start] != place[end - 1]).astype(np.int64)
    owner = np.searchsorted(first, start, side="right") - 1
    hashes = rolling.ranges(start, end + length - 1)
    return owner, start - first[owner], end - start, several, anchor[start], hashes


def phrases(docs: DataFrame, kind: str, length: int, k: int, modulus: int | None) -> DataFrame:
    """anchor, phrase, did, th, loc of all phrases; loc holds tag, the first window's place, whether the anchor has several places and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                owner, start, n, several, anchor, phrase = phrases_of(Units(text, kind), length, k, modulus)
                did, th, tag = (rows.column(i).to_numpy(zero_copy_only=False)[owner] for i in range(3))
                loc = (tag << 41) | (start << 9) | (several << 8) | n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (K.signed(anchor), K.signed(phrase), did, th, loc)], names=["anchor", "phrase", "did", "th", "loc"])

    return docs.mapInArrow(run, _PHRASE)


def in_loc() -> tuple[Column, Column, Column, Column]:
    """(tag, first window's place, 1 if the anchor has several places, number of windows) as loc has them."""
    return F.shiftrightunsigned("loc", 41), F.expr("shiftright(loc, 9) & 4294967295L"), F.expr("shiftright(loc, 8) & 1"), F.expr("loc & 255")


def picked(docs: DataFrame, by: DataFrame) -> DataFrame:
    """The rows of docs whose did is in ``by``, or all if those are too many to broadcast: a filter before a join."""
    ids = by.select("did").distinct()
    return docs.join(F.broadcast(ids), "did", "left_semi") if ids.count() <= BROADCAST_IDS else docs


def cuttings(docs: DataFrame, compared: DataFrame, kind: str, length: int) -> DataFrame:
    """anchor, phrase, did, size and cut (the text) of the phrases ``compared`` (anchor, phrase, size, did, th, tag, start, n)."""
    names = ("anchor", "phrase", "size", "start", "n")
    lists = compared.groupBy(*ROW).agg(*(F.collect_list(c).alias(c) for c in names))
    held = picked(docs, compared).join(lists, ROW).dropDuplicates(ROW).select("did", *names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                u = Units(text, kind)
                each = np.diff(rows.column(1).offsets.to_numpy())
                anchor, phrase, size = (rows.column(i).flatten() for i in (1, 2, 3))
                start, n = (rows.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5))
                owner = np.repeat(np.arange(len(each)), each)
                begin = u.first[owner] + start
                end = begin + n + length - 1
                if kind == "words":
                    begin, end = u.words.start[begin], u.words.end[end - 1]
                    raw = u.words.data.tobytes()
                else:
                    raw = u.data.tobytes()
                did = rows.column(0).take(pa.array(owner))
                for at in range(0, len(owner), 4096):
                    cut = pa.array([raw[x:y] for x, y in zip(begin[at : at + 4096].tolist(), end[at : at + 4096].tolist(), strict=True)], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([*(x.slice(at, 4096) for x in (anchor, phrase, did, size)), cut], names=["anchor", "phrase", "did", "size", "cut"])

    return held.mapInArrow(run, "anchor long, phrase long, did long, size long, cut binary")


def windows(u: Units, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, place in the block) of all windows of cuttings."""
    n = np.maximum(np.diff(u.first) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, at, u.first[row] + at


def side_by_side(cut: DataFrame, judge: Judge) -> DataFrame:
    """anchor, phrase, ats (places of repeated windows) of each cutting with any; an anchor's cuttings meet in one task."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        row, at = judge(rows)
        order = np.lexsort((at, row))
        some, count = np.unique(row, return_counts=True)
        ats = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), type=pa.int32()), pa.array(at[order], type=pa.int32()))
        return pa.RecordBatch.from_arrays([*(pa.array(rows.column(c).to_numpy()[some]) for c in ("anchor", "phrase")), ats], names=["anchor", "phrase", "ats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                wait.append(part)
                held += part.num_rows
                last = part.column(0)[-1].as_py()
                if held < 1024 or wait[0].column(0)[0].as_py() == last:
                    continue
                # All but the last anchor's, of which more may come.
                table = pa.Table.from_batches(wait)
                end = int(np.flatnonzero(table.column("anchor").to_numpy() != last)[-1]) + 1
                yield judged(table.slice(0, end))
                wait = table.slice(end).to_batches()
                held = table.num_rows - end
        if wait:
            yield judged(pa.Table.from_batches(wait))

    return cut.select("anchor", "phrase", "did", "cut").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, phrase long, ats array<int>")


def by_shuffle(cut: DataFrame, kind: str, length: int, earlier: bool) -> DataFrame:
    """As side_by_side(), for anchors with any number of cuttings: each window's hash is counted on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                u = Units(part.column(3).cast(pa.large_binary()), kind)
                row, at, place = windows(u, length)
                h = K.Rolling(u.codes, K.BASES[1]).ranges(place, place + length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(at, type=pa.int32()), pa.array(K.signed(h))], names=["anchor", "phrase", "did", "at", "window"])

    every = cut.select("anchor", "phrase", "did", "cut").mapInArrow(run, "anchor long, phrase long, did long, at int, window long")
    by_window = every.groupBy("anchor", "window").agg(F.min("did").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    by_window = stored(by_window, "repeated-windows")
    hit = every.hint("merge").join(by_window, ["anchor", "window"]).filter("least < did" if earlier else "times > 1")
    return hit.groupBy("anchor", "phrase").agg(F.collect_list("at").alias("ats"))


def spans(docs: DataFrame, kind: str, length: int, k: int, modulus: int | None, earlier: bool, judge: Judge, name: str) -> DataFrame:
    """ROW, spans (list of start, n, ats) of the documents that hold repeated windows.

    ``docs`` is keyed(). A span's windows are start .. start + n - 1 where ats is null, else start + ats.
    earlier: a window counts as repeated if a document with a smaller id holds it; else if it starts anywhere else.
    ``judge`` tells that of the windows of phrases that share an anchor.
    """
    with scratch(docs.sparkSession) as tables:
        tag, start, several_places, n = in_loc()
        places = 1 + several_places
        all_ = stored(phrases(docs, kind, length, k, modulus), f"{name}-all")
        anchors = all_.groupBy("anchor").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.sum(places).alias("places")).filter("least < most" if earlier else "places > 1").select("anchor")
        # Stored, so that both sides of the join are plain shuffles, which Spark splits where an anchor is very frequent; likewise below.
        anchors = stored(anchors, f"{name}-anchors")
        found = stored(all_.hint("merge").join(anchors, "anchor"), f"{name}-phrases")
        # Of rows with the least id, both min_by take the same one.
        dictionary = found.groupBy("anchor", "phrase").agg(F.min("did").alias("least"), F.min_by("th", "did").alias("th"), F.min_by("loc", "did").alias("loc"), F.count(F.lit(1)).alias("times"))
        dictionary = stored(dictionary, f"{name}-dictionary")
        several = stored(dictionary.groupBy("anchor").agg(F.sum(places).alias("size")).filter("size > 1"), f"{name}-several")
        compared = dictionary.hint("merge").join(several, "anchor").select("anchor", "phrase", "size", F.col("least").alias("did"), "th", tag.alias("tag"), start.alias("start"), n.alias("n"))
        cut = stored(cuttings(docs, stored(compared, f"{name}-compared"), kind, length), f"{name}-cuttings")
        ats = side_by_side(cut.filter(F.col("size") <= GROUP), judge)
        if (cut.agg(F.max("size")).first()[0] or 0) > GROUP:
            ats = ats.union(by_shuffle(cut.filter(F.col("size") > GROUP), kind, length, earlier))
        judged = dictionary.join(ats, ["anchor", "phrase"], "left").filter(F.col("ats").isNotNull() | (F.col("times") > 1)).select("anchor", "phrase", "least", "times", "ats")
        judged = stored(judged, f"{name}-judged")
        hits = found.hint("merge").join(judged, ["anchor", "phrase"])
        hits = hits.withColumn("whole", F.expr("did > least" if earlier else "times > 1")).filter(F.col("whole") | F.col("ats").isNotNull())
        span = F.struct(start.alias("start"), n.alias("n"), F.when(~F.col("whole"), F.col("ats")).alias("ats"))
        # A set, as rows with one key have the same spans.
        return tables.keep(hits.groupBy("did", "th", tag.alias("tag")).agg(F.collect_set(span).alias("spans")), f"{name}-spans")


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (keyed()) and their spans, null if they have none. Only texts with spans are shuffled, as long as their ids can be broadcast."""
    ids = found.select("did").distinct()
    if ids.count() > BROADCAST_IDS:
        return docs.join(found, ROW, "left")
    held = docs.join(F.broadcast(ids), "did", "left_semi").join(found, ROW, "left")
    return held.unionByName(docs.join(F.broadcast(ids), "did", "left_anti").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))


def covered(rows: pa.RecordBatch, column: int, first: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which units of a block lie in a window of its spans."""
    step = np.zeros(size + 1, dtype=np.int64)
    lists = rows.column(column)
    each = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if len(flat):
        owner = np.repeat(np.arange(len(each)), each)
        start = first[owner] + flat.field("start").to_numpy(zero_copy_only=False)
        n = flat.field("n").to_numpy(zero_copy_only=False)
        ats = flat.field("ats")
        whole = ats.is_null().to_numpy(zero_copy_only=False)
        np.add.at(step, start[whole], 1)
        np.add.at(step, (start + n + length - 1)[whole], -1)
        some = ats.filter(pa.array(~whole))
        if len(some):
            place = np.repeat(start[~whole], np.diff(some.offsets.to_numpy())) + some.flatten().to_numpy(zero_copy_only=False)
            np.add.at(step, place, 1)
            np.add.at(step, place + length, -1)
    return np.cumsum(step[:-1]) > 0
