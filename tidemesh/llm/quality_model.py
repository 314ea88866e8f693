"""Quality classifier on supervised subword embeddings.

A document is the average of the learned vectors of its words and of their character n-grams, hashed into a fixed number of
buckets, and of one more for each word that equals the one before it; a softmax over the average gives the label. Vectors and
output are trained together by plain stochastic gradient descent in numpy on a bounded sample. For two labels the
softmax needs only each bucket's share of the logit, so a text is scored by one number for each of its distinct words.

The vector for repeated words adds to the method: texts that stammer hold the same words and n-grams as others. Without
it, and with hashed pairs of neighbouring words in its place, a fifth of the bad documents goes unnoticed (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.labelled import remainder, sample
from tidemesh.llm.subwords import Distinct

BUCKETS = 1 << 16
DIMENSIONS = 10
GRAMS = (2, 3, 4)
#: The marker's bucket, and how many features one counts for.
MARKER, MARKS = BUCKETS, 5
EPOCHS = 6
#: Learning rate of the output, falling to 0, and, as a multiple of it, that of the vectors, each of which has but a share of the average.
RATE, VECTOR_RATE = 0.3, 100.0


def features(text: pa.Array) -> tuple[Distinct, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words, and (bucket, distinct word) of all their features: the word itself and its n-grams."""
    d = Distinct(text, parts=False)
    mask = np.uint64(BUCKETS - 1)
    out = [((d.hashes & mask).astype(np.int64), np.arange(len(d.hashes)))]
    for k in GRAMS:
        h, owner = d.grams(k)
        out.append(((h & mask).astype(np.int64), owner))
    return d, out


def repeats(d: Distinct) -> np.ndarray:
    """Of each text of a block, the words that equal the one before."""
    of = d.words.owner()
    again = of[1:][(d.codes[1:] == d.codes[:-1]) & (of[1:] == of[:-1])]
    return np.bincount(again, minlength=len(d.words.first) - 1)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that sum to 1) of each text."""
    out = []
    for _, text in K.blocks(pa.RecordBatch.from_arrays([texts], names=["text"])):
        for i in range(len(text)):
            d, found = features(text.slice(i, 1))
            times = np.bincount(d.codes, minlength=len(d.hashes))
            bucket = np.concatenate([*(b for b, _ in found), [MARKER]])
            weight = np.concatenate([*(times[o] for _, o in found), MARKS * repeats(d)])
            distinct, back = np.unique(bucket, return_inverse=True)
            total = np.bincount(back, weights=weight, minlength=len(distinct))
            out.append((distinct, total / max(total.sum(), 1.0)))
    return out


class Model:
    def __init__(self, texts: pa.Array, labels: list[int], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        vectors = r.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 1, DIMENSIONS))
        output, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
        docs, label = bags(texts), np.array(labels, dtype=np.int64)
        steps = EPOCHS * len(docs)
        for step, i in enumerate(np.concatenate([r.permutation(len(docs)) for _ in range(EPOCHS)]) if docs else []):
            rate = RATE * (1 - step / steps)
            bucket, weight = docs[i]
            hidden = weight @ vectors[bucket]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[bucket] -= VECTOR_RATE * rate * np.outer(weight, back)
        self.share = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def score(self, text: pa.Array) -> np.ndarray:
        d, found = features(text)
        value, size = np.zeros(len(d.hashes)), np.zeros(len(d.hashes))
        for bucket, owner in found:
            value += np.bincount(owner, weights=self.share[bucket], minlength=len(value))
            size += np.bincount(owner, minlength=len(size))
        of, n = d.words.owner(), len(text)
        marks = MARKS * repeats(d)
        total = np.bincount(of, weights=value[d.codes], minlength=n) + marks * self.share[MARKER]
        total /= np.maximum(np.bincount(of, weights=size[d.codes], minlength=n) + marks, 1)
        return 1 / (1 + np.exp(-(total + self.bias)))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; labels (doc_id, quality) of the folds other than 0 are learned from.

    Null and empty texts have no features and get the score of the bias alone; without labelled rows every score is
    0.5. Repeated rows and rows without an id are scored one by one; null labels and other columns are ignored; of an empty table
    the result is empty. A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, known = sample(docs, labels.filter(remainder("doc_id", folds) != 0).select("doc_id", F.col("quality").cast("int").alias("label")))
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.value.score(text))], names=["doc_id", "score"])

    found = docs.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
