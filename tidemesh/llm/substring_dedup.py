"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

The corpus is its own reference, indexed in blocks: a block holds all runs of 50 words with one anchor (spans.py), that
is, everything that a window with this anchor can agree with, each distinct phrase once and under its smallest doc_id.
A document is factored against every block that one of its windows has the anchor of; phrases overlap by 49 words, so that no window
lies between two of them. ``Block`` is the index: it finds, for each window, where the earliest document holds it. ``factors`` parses a
phrase greedily: where the index has a window in an earlier document, the factor grows word by word for as long as both
agree. Behind its last word the parse goes on, but windows that reach over that bound may come from elsewhere: the next
one is looked up from 49 words before it. Factors of 50 words and more are the duplicate spans; a phrase that an earlier
document holds as a whole is one factor without parsing.

A block of more than spans.GROUP phrases is not held by one task: its windows are looked up by a shuffle of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.spans import NO_ID, Units, covered, keyed, spans, windows, with_spans

LENGTH = 50
TRIGGER = 12


class Block:
    """The windows of reference blocks side by side: rows are phrases, sorted or not, of which those with one anchor form a block."""

    def __init__(self, anchor: np.ndarray, did: np.ndarray, cut: pa.Array, length: int) -> None:
        self.units = u = Units(cut.cast(pa.large_binary()), "words")
        self.did, self.length = did, length
        self.row, self.at, place = windows(u, length)
        key = K.Rolling(u.codes, K.BASES[1]).ranges(place, place + length)
        order = np.lexsort((self.at, self.row, did[self.row], key, anchor[self.row]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (anchor[self.row[order]][1:] != anchor[self.row[order]][:-1])
        #: For each window, the one of the smallest doc_id that equals it.
        self.source = np.empty(len(order), dtype=np.int64)
        self.source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        self.place = place

    def earlier(self) -> np.ndarray:
        """Which windows an earlier document holds, by their hash."""
        return self.did[self.row[self.source]] < self.did[self.row]

    def agree(self, window: int) -> int:
        """How many words from ``window`` on agree with those from its source on."""
        here, there = int(self.place[window]), int(self.place[self.source[window]])
        ends = self.units.first
        most = int(min(ends[self.row[window] + 1] - here, ends[self.row[self.source[window]] + 1] - there))
        differ = self.units.codes[here : here + most] != self.units.codes[there : there + most]
        return int(differ.argmax()) if differ.any() else most


def factors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, words) of the factors of all phrases of a block that are long enough."""
    hits = np.flatnonzero(block.earlier())
    out = []
    i = 0
    while i < len(hits):
        window = int(hits[i])
        size = block.agree(window)
        if size < block.length:  # equal hashes of different words
            i += 1
            continue
        row, at = int(block.row[window]), int(block.at[window])
        out.append((row, at, size))
        # A phrase's windows are numbered in a row; the next to look up is the first that reaches over the factor's end.
        i += int(np.searchsorted(hits[i:], window + size - block.length + 1))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def duplicate_spans(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """ROW, spans of the documents that hold ``length`` words in a row that start in a document with a smaller id, see spans.spans()."""

    def judge(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block = Block(rows.column("anchor").to_numpy(), rows.column("did").to_numpy(), rows.column("cut").combine_chunks(), length)
        row, at, size = factors(block)
        each = size - length + 1
        return np.repeat(row, each), np.repeat(at - (np.cumsum(each) - each), each) + np.arange(each.sum())

    return spans(docs, "words", length, trigger, None, True, judge, "substring")


def dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (remaining words, joined by a space), n_words, n_removed, kept_sha256 of each document.

    Null texts have no words. Rows with one doc_id aren't compared with each other; a null doc_id is after all others
    and kept as null. Other columns are ignored but for those in ``keep``, which are handed on. Of an empty table the result is
    empty. A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    keys = keyed(docs)
    rows_ = keyed(docs, keep)
    joined = with_spans(rows_, duplicate_spans(keys, length, trigger)).select("did", "spans", "text", *(c for c in keep if c != "text"))
    types = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                u = Units(text, "words")
                w = u.words
                gone = covered(rows, 1, u.first, len(u.codes), length)
                raw = w.data.tobytes()
                start, end, left = w.start.tolist(), w.end.tolist(), (~gone).tolist()
                kept = [b" ".join([raw[start[i] : end[i]] for i in range(a, b) if left[i]]) for a, b in zip(u.first[:-1].tolist(), u.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(rows.column(batch.schema.get_field_index(c)) for c in keep), pa.array([x.decode() for x in kept], type=pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(K.sums_by(u.first, gone)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                    names=["did", *keep, "kept", "n_words", "n_removed", "kept_sha256"],
                )

    out = joined.mapInArrow(run, f"did long, {types}{', ' if keep else ''}kept string, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), *keep, "kept", "n_words", "n_removed", "kept_sha256")
