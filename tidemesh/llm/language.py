"""Language identification by words first, then by ever shorter character n-grams.

A word known from the sample scores by its log frequency in each language. An unseen word backs off to the
longest n for which any of its n-grams (with marks at the word's ends) is known, and scores by their mean log
frequency. A text's score is the softmax of the sum over its words, which are taken without ASCII signs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemesh.llm import kernel as K
from tidemesh.llm.labelled import remainder, sample
from tidemesh.llm.store import nullable
from tidemesh.llm.subwords import Distinct, Table

LONGEST = 5
#: Bounds of the sample, see labelled.sample().
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 12 << 20
MOST_WORDS = 40_000
MOST_GRAMS = 30_000
#: Words beyond so many don't make a score surer.
SURE = 40
UNKNOWN = "und"


class Model:
    """Centred log frequencies by language of words (``tables[0]``) and of n-grams for each n."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        label = np.array([self.langs.index(x) for x in langs], dtype=np.int64)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LONGEST + 1)]
        at = 0
        for _, text in K.blocks(pa.RecordBatch.from_arrays([texts], names=["text"])):
            d = Distinct(text, parts=True)
            lang = label[at : at + len(text)][d.words.owner()]
            at += len(text)
            by = np.bincount(d.codes * len(self.langs) + lang, minlength=len(d.hashes) * len(self.langs)).reshape(len(d.hashes), -1)
            keep = d.lettered()
            seen[0].append((d.hashes[keep], by[keep]))
            for k in range(1, LONGEST + 1):
                h, owner = d.grams(k, np.flatnonzero(keep))
                seen[k].append(self._added([(h, by[owner])]))
        self.tables = [self._table(x, MOST_GRAMS if k else MOST_WORDS) for k, x in enumerate(seen)]

    def _added(self, seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and the sums of their counts by language."""
        codes, hashes = pd.factorize(np.concatenate([h for h, _ in seen]))
        counts = np.zeros((len(hashes), len(self.langs)))
        for j in range(len(self.langs)):
            counts[:, j] = np.bincount(codes, weights=np.concatenate([c[:, j] for _, c in seen]), minlength=len(hashes))
        return hashes, counts

    def _table(self, seen: list[tuple[np.ndarray, np.ndarray]], most: int) -> Table:
        if not seen:
            return Table(np.empty(0, dtype=np.uint64), np.empty((0, len(self.langs))))
        hashes, counts = self._added(seen)
        total = counts.sum(1)
        order = np.lexsort((hashes, -total))[:most]
        order = order[total[order] >= 2]
        log = np.log((counts[order] + 0.5) / (counts.sum(0) + 0.5 * len(hashes)))
        return Table(hashes[order], log - log.mean(1, keepdims=True))

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, score) of each text of a block."""
        d = Distinct(text, parts=True)
        n = len(text)
        value = np.zeros((len(d.hashes), len(self.langs)))
        found = self.tables[0].find(d.hashes)
        value[found >= 0] = self.tables[0].values[found[found >= 0]]
        lettered = d.lettered()
        open_ = np.flatnonzero((found < 0) & lettered)
        for k in range(LONGEST, 0, -1):
            h, owner = d.grams(k, open_)
            row = self.tables[k].find(h)
            owner, row = owner[row >= 0], row[row >= 0]
            hits = np.bincount(owner, minlength=len(value))
            for j in range(len(self.langs)):
                total = np.bincount(owner, weights=self.tables[k].values[row, j], minlength=len(value))
                value[:, j] += total / np.maximum(hits, 1)
            open_ = open_[hits[open_] == 0]
        of, scored = d.words.owner(), lettered[d.codes]
        words = np.bincount(of[scored], minlength=n)
        total = np.stack([np.bincount(of, weights=value[d.codes, j], minlength=n) for j in range(len(self.langs))], axis=1).astype(float)
        total *= (np.minimum(words, SURE) / np.maximum(words, 1))[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, score = p.argmax(1), p.max(1)
        blank = words == 0
        # Only bytes beyond ASCII: they may all be signs.
        ascii_letters = K.sums_by(d.words.offsets, ((d.words.data | 0x20) >= 97) & ((d.words.data | 0x20) <= 122))
        for i in np.flatnonzero(~blank & (ascii_letters == 0)):
            blank[i] = not any(c.isalpha() for c in text[int(i)].as_py())
        return np.where(blank, -1, best), np.where(blank, 0.0, score)


def identify(docs: DataFrame, folds: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, and its columns ``keep``; the model is learned from a bounded sample of the folds other than 0.

    Null texts, texts without letters and, if nothing is labelled, all texts are ``und`` with score 0. Repeated rows and rows without
    an id are predicted one by one, ties go to the first language by name, other columns are ignored; of an empty table the result
    is empty. A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *(F.col(c).alias(f"_{c}") for c in keep))
    texts, langs = sample(docs, docs.filter(remainder("doc_id", folds) != 0).select("doc_id", F.col("lang").alias("label")), SAMPLE_DOCS, SAMPLE_BYTES)
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, langs) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, UNKNOWN] if m else [UNKNOWN], dtype=object)
        for batch in batches:
            for rows, text in K.blocks(batch):
                best, score = m.predict(text) if m else (np.full(len(text), -1), np.zeros(len(text)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best], type=pa.string()), pa.array(score), *rows.columns[2:]], names=["doc_id", "lang_pred", "score", *rows.schema.names[2:]])

    rows = docs.select("doc_id", "text", *(f"_{c}" for c in keep))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *nullable(rows.schema).fields[2:]])
    found = rows.mapInArrow(run, schema)
    return found.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score", *(F.col(f"_{c}").alias(c) for c in keep))
