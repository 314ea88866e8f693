"""Removal of repeated 200-byte strings by prefix-free parsing.

Texts are cut into phrases at triggers, strings of 40 bytes whose rolling hash is 0 modulo a constant. Being a
function of their bytes alone, triggers fall alike in every copy of a passage, and no phrase, which ends with the
trigger that the next one begins with, is a prefix of another. The distinct phrases, each with the bytes that follow
it in the parse as far as a suffix cut to 200 bytes reaches, are the dictionary; the parse is each document's sequence of
phrases, of which the times that each is used are counted (spans.py). A stretch of 200 bytes without a trigger takes
the string of the least hash in its place, so no phrase grows beyond 200 bytes and a text free of triggers needs no other path.

Corpus order, that of all suffixes cut to 200 bytes, is made from two smaller orders. ``dictionary_order`` is the suffix array
of the phrases: what is left of each phrase from a suffix's first byte to its trigger's end. ``parse_order`` is that
of the parse: the bytes from each trigger on, with the common prefixes of neighbours. ``corpus_order`` ranks a suffix by the first and then by
the second; two suffixes agree on 200 bytes if and only if they agree up to the trigger's end and what follows has
the rest in common. Suffixes can only agree if their triggers do, so the orders are made for the dictionary's
phrases of one trigger string at a time, in one task, and only for triggers that occur twice or more; phrases used
twice are repeated as a whole. Beyond spans.GROUP distinct phrases of a trigger, suffixes are grouped
by the hash of their 200 bytes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.spans import NO_ID, Units, anchor_places, covered, keyed, spans, windows, with_spans

LENGTH = 200
TRIGGER = 40
#: One in so many strings is a trigger.
MODULUS = 80


def dictionary_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of the suffix that begins at each byte and ends at ``ends`` of that byte, in lexicographic order; equal suffixes have equal ranks.

    Prefix doubling: from the ranks by h bytes come those by 2 h. A string that ends comes before those that go on.
    """
    n = len(data)
    place = np.arange(n)
    left = ends - place
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):
        at = np.minimum(place + i, max(n - 1, 0))
        key = key * 257 + np.where(left > i, data[at].astype(np.int64) + 1, 0)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    done = 7
    while done < left.max(initial=0) and rank.max(initial=0) < n:
        after = np.where(left > done, rank[np.minimum(place + done, n - 1)], 0)
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        done *= 2
    return rank


def parse_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each parse suffix data[start : start + size] in lexicographic order, bytes that the suffix of each rank has in common with the one before it)."""
    m = len(start)
    if not m:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    width = -(-length // 4) * 4
    table = np.zeros((m, width), dtype=">u2")
    for low in range(0, m, 1024):
        some = slice(low, low + 1024)
        at = start[some, None] + np.arange(width)
        table[some] = np.where(np.arange(width) < size[some, None], data[np.minimum(at, max(len(data) - 1, 0))].astype(np.uint16) + 1, 0)
    lanes = table.view(">u8").astype(np.uint64)
    order = np.lexsort(lanes.T[::-1])
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.arange(m)
    table, size = table[order], size[order]
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    return rank, np.concatenate([[0], np.minimum(first, np.minimum(size[1:], size[:-1]))])


def first_of_equals(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each one's distinct hash, place of each distinct hash's first one)."""
    codes, distinct = pd.factorize(hashes)
    place = np.zeros(len(distinct), dtype=np.int64)
    place[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, place


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low + 1 .. high] for each pair low < high."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=np.int64)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(table[k][low[mine] + 1], table[k][high[mine] + 1 - (1 << int(k))])
    return out


def corpus_order(cut: pa.Array, length: int, k: int, modulus: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, bytes in common with the one before, bytes in common with the one after) of the suffixes of dictionary phrases with their context, in corpus order.

    Suffixes with a first ``length`` bytes that hash like no other's agree with none and are left out beforehand. Those that
    differ up to their trigger's end count as having nothing in common, as only common prefixes of ``length`` bytes and more are asked for.
    """
    u = Units(cut.cast(pa.large_binary()), "bytes")
    rolling = K.Rolling(u.codes, K.BASES[0])
    _, place = anchor_places(rolling, length, k, modulus)
    row, at, start = windows(u, length)
    alike = pd.factorize(rolling.ranges(start, start + length))[0]
    alike = np.bincount(alike)[alike] > 1 if len(alike) else np.empty(0, dtype=bool)
    row, at, start = row[alike], at[alike], start[alike]
    trigger = place[start]
    # A phrase is what lies before one trigger; a row of periodic text has several.
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (trigger[1:] != trigger[:-1])
    phrase = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    low, high = start[begins], trigger[begins] + k
    # The distinct phrases one after another, each to its trigger's end.
    distinct, one = first_of_equals(rolling.ranges(low, high))
    size = (high - low)[one]
    base = np.cumsum(size) - size
    flat = np.repeat(low[one] - base, size) + np.arange(size.sum())
    word = dictionary_order(u.data[flat], np.repeat(base + size, size))[base[distinct[phrase]] + start - low[phrase]]
    # The distinct parse suffixes.
    context = np.minimum(length, u.first[row[begins] + 1] - trigger[begins])
    distinct, one = first_of_equals(rolling.ranges(trigger[begins], trigger[begins] + context))
    parse_rank, common = parse_order(u.data, trigger[begins][one], context[one], length)
    after = parse_rank[distinct][phrase]
    order = np.argsort(word * (len(one) + 1) + after)
    word, after, reach, rest = word[order], after[order], (trigger - start)[order], context[phrase][order]
    same = word[1:] == word[:-1]
    shared = np.zeros(max(len(order) - 1, 0), dtype=np.int64)
    both = same & (after[1:] == after[:-1])
    shared[both] = reach[1:][both] + rest[1:][both]
    both = same & (after[1:] != after[:-1])
    shared[both] = reach[1:][both] + least_between(common, after[:-1][both], after[1:][both])
    return row[order], at[order], np.concatenate([[0], shared])[: len(order)], np.concatenate([shared, [0]])[: len(order)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, modulus: int = MODULUS) -> DataFrame:
    """ROW, spans of the documents that hold a string of ``length`` bytes that starts anywhere else, see spans.spans()."""

    def judge(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        row, at, before, after = corpus_order(rows.column("cut").combine_chunks(), length, trigger, modulus)
        hit = np.maximum(before, after) >= length
        return row[hit], at[hit]

    return spans(docs, "bytes", length, trigger, modulus, False, judge, "suffix")


def dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, modulus: int = MODULUS) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans, kept_sha256 of each document.

    Null texts count as empty. Rows are documents of their own even if they share a doc_id or have none, so equal rows repeat each
    other; a null doc_id is kept as null. Remaining bytes may cut through a character. Other columns are ignored. Of an empty
    table the result is empty. A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    keys = keyed(docs)
    joined = with_spans(keys, repeated_spans(keys, length, trigger, modulus)).select("did", "spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                data, first = K.buffers(text)
                gone = covered(rows, 1, first, len(data), length)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = first[:-1][first[:-1] < len(data)]
                begins[edge] = gone[edge]
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(kept, type=pa.binary()), pa.array(np.diff(first)), pa.array(K.sums_by(first, gone)), pa.array(K.sums_by(first, begins)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                    names=["did", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    out = joined.mapInArrow(run, "did long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
