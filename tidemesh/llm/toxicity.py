"""Toxicity classifier, regularised by counterfactuals.

Logistic regression on which words, and which beginnings of words, a text holds. In the labelled texts each identity term is
swapped for the other terms of its group, and for none, and the squared change of the text's logit is added to the
loss, so that naming one group rather than another, or any, can't move the score. A swap changes all features of the term
that no other word of the text has, its beginnings too.

Identity terms are a parameter. To them come groups learned from the sample: frequent words that stand in like contexts and are
as frequent under both labels may stand for one another as well (``alike``). Features are scaled by their log ratio between
the labels, both labels weigh the same, and weights shrink towards 0 (L1); rare features have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.labelled import remainder, sample
from tidemesh.llm.subwords import Distinct, Table

#: Terms of a group may stand for one another in a sentence.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("african", "european", "american", "mexican", "chinese", "indian", "french", "german", "spanish"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("mujeres", "hombres", "chicas", "chicos"),
)
#: Lengths of beginnings, in characters; the most features, those of most texts first.
BEGINNINGS = (4, 5)
MOST_FEATURES = 60_000
LEAST_TEXTS = 4
PENALTY = 20.0
#: Learned groups: texts that a word must be in (and their share), its log ratio between the labels at most, likeness of contexts, sizes.
ALIKE_TEXTS, ALIKE_SHARE, ALIKE_BIAS, LIKENESS, ALIKE_WORDS, ALIKE_GROUP, CONTEXTS = 20, 0.02, 0.4, 0.7, 400, 4, 300
#: Words of learned groups that are swapped in a text at most, chosen at random; identity terms are swapped wherever they occur.
ALIKE_SWAPS = 8
SHRINK = 1e-3
EPOCHS = 25
RATE = 0.5


def pairs_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, word) of a block, each once: hashes of the words (parts without ASCII signs) and of their beginnings, with the word that has them."""
    d = Distinct(text, parts=True)
    keep = d.lettered()[d.codes]
    n = max(len(d.hashes), 1)
    pairs = np.unique(d.words.owner()[keep] * n + d.codes[keep])
    doc, word = pairs // n, pairs % n
    docs, hashes, words = [doc], [d.hashes[word]], [d.hashes[word]]
    for k in BEGINNINGS:
        h = np.zeros(n, dtype=np.uint64)
        has = np.zeros(n, dtype=bool)
        found, owner = d.beginnings(k, np.unique(word))
        h[owner], has[owner] = found, True
        pick = has[word]
        docs.append(doc[pick])
        hashes.append(h[word[pick]])
        words.append(d.hashes[word[pick]])
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(words)


def held(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a block, each once."""
    doc, hashes, _ = pairs_of(text)
    codes, distinct = pd.factorize(hashes)
    pairs = np.unique(doc * max(len(distinct), 1) + codes)
    return pairs // max(len(distinct), 1), distinct[pairs % max(len(distinct), 1)]


def features_of(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hash of each word, the features that a text with it has)."""
    text = pa.array(words, type=pa.large_string())
    doc, hashes, word = pairs_of(text)
    assert all(len(np.unique(word[doc == i])) == 1 for i in range(len(words))), "a term has to be one word"
    return np.array([word[doc == i][0] for i in range(len(words))], dtype=np.uint64), [hashes[doc == i] for i in range(len(words))]


def alike(texts: pa.Array, labels: np.ndarray) -> list[np.ndarray]:
    """Groups of words, by their hashes, that stand in like contexts and are as frequent under both labels."""
    sequences, docs, at = [], [], 0
    for _, text in K.blocks(pa.RecordBatch.from_arrays([texts], names=["text"])):
        d = Distinct(text, parts=True)
        keep = d.lettered()[d.codes]
        sequences.append(d.hashes[d.codes][keep])
        docs.append(d.words.owner()[keep] + at)
        at += len(text)
    if not sequences or not sum(map(len, sequences)):
        return []
    codes, words = pd.factorize(np.concatenate(sequences))
    doc = np.concatenate(docs)
    once = np.unique(codes * len(labels) + doc)
    word, of = once // len(labels), once % len(labels)
    total = np.bincount(word, minlength=len(words))
    toxic = np.bincount(word, weights=labels[of], minlength=len(words))
    bias = np.log((toxic + 1) / (labels.sum() + 2)) - np.log((total - toxic + 1) / (len(labels) - labels.sum() + 2))
    by_use = np.lexsort((words, -total))
    common = by_use[:CONTEXTS]
    chosen = by_use[(total[by_use] >= max(ALIKE_TEXTS, ALIKE_SHARE * len(labels))) & (np.abs(bias[by_use]) <= ALIKE_BIAS)][:ALIKE_WORDS]
    if len(chosen) < 2:
        return []
    row, column = np.full(len(words), -1), np.full(len(words), -1)
    row[chosen], column[common] = np.arange(len(chosen)), np.arange(len(common))
    seen = np.zeros((len(chosen), 2 * len(common)))
    beside = np.flatnonzero(doc[1:] == doc[:-1])
    for here, there, side in ((beside + 1, beside, 0), (beside, beside + 1, len(common))):
        ok = (row[codes[here]] >= 0) & (column[codes[there]] >= 0)
        np.add.at(seen, (row[codes[here][ok]], column[codes[there][ok]] + side), 1)
    seen = np.sqrt(seen)
    seen /= np.maximum(np.sqrt((seen**2).sum(1, keepdims=True)), 1e-12)
    like = seen @ seen.T
    free, groups = np.ones(len(chosen), dtype=bool), []
    for i in range(len(chosen)):
        if free[i]:
            free[i] = False
            near = np.flatnonzero(free & (like[i] >= LIKENESS))
            near = near[np.argsort(-like[i][near], kind="stable")][: ALIKE_GROUP - 1]
            if len(near):
                free[near] = False
                groups.append(words[chosen[np.append(i, near)]])
    return groups


class Model:
    """swaps: the number of swaps that were fitted."""

    def __init__(self, texts: pa.Array, labels: list[int], seed: int = 3, penalty: float = PENALTY, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> None:
        docs, hashes, words, at = [], [], [], 0
        for _, text in K.blocks(pa.RecordBatch.from_arrays([texts], names=["text"])):
            d, h, w = pairs_of(text)
            docs.append(d + at)
            hashes.append(h)
            words.append(w)
            at += len(text)
        label = np.array(labels, dtype=float)
        own, own_features = features_of([t for g in identity for t in g]) if identity else (np.empty(0, dtype=np.uint64), [])
        given = np.split(own, np.cumsum([len(g) for g in identity])[:-1]) if identity else []
        learned = alike(texts, label) if penalty and len(label) else []
        doc = np.concatenate([*docs, np.empty(0, dtype=np.int64)])
        every = np.concatenate([*hashes, *own_features, np.empty(0, dtype=np.uint64)])
        codes, distinct = pd.factorize(every)
        code = codes[: len(doc)]
        # (text, feature) once, with the number of the text's words that have it.
        size = max(len(distinct), 1)
        pairs, words_with = np.unique(doc * size + code, return_counts=True)
        times = np.bincount(pairs % size, minlength=len(distinct))
        named = np.zeros(len(distinct), dtype=bool)
        named[codes[len(doc) :]] = True
        order = np.lexsort((distinct, -times, ~named))[:MOST_FEATURES]
        order = order[(times[order] >= LEAST_TEXTS) | named[order]]
        number = np.full(len(distinct), -1)
        number[order] = np.arange(len(order))
        kept = number[pairs % size] >= 0
        text, column, words_with = (pairs // size)[kept], number[pairs % size][kept], words_with[kept]
        toxic = np.bincount(column, weights=label[text], minlength=len(order))
        clean = np.bincount(column, minlength=len(order)) - toxic
        scale = np.abs(np.log((toxic + 1) / (label.sum() + 2)) - np.log((clean + 1) / (len(label) - label.sum() + 2)))
        r = np.random.default_rng(seed)
        # Features of the words that are swapped, by the word's hash.
        word = np.concatenate([*words, np.empty(0, dtype=np.uint64)])
        groups = [np.asarray(g) for g in (*given, *learned)]
        at = Table(distinct, number)
        has = {h: at.values[at.find(f)] for h, f in zip(own.tolist(), own_features, strict=True)}
        wanted = {int(h) for g in groups for h in g}
        mine = np.flatnonzero(np.isin(word, np.array(sorted(wanted), dtype=np.uint64)))
        for h in {int(x) for g in learned for x in g} - set(has):
            has[h] = np.unique(number[code[mine[word[mine] == np.uint64(h)]]])
        holds = [(int(doc[i]), int(word[i])) for i in mine[every[mine] == word[mine]]] if penalty else []
        holds = sorted(set(holds))
        spare = set(own.tolist())
        luck = np.where([h in spare for _, h in holds], -1.0, r.random(len(holds)))
        by_luck = np.lexsort((luck, [d for d, _ in holds])) if holds else np.empty(0, dtype=np.int64)
        place = np.arange(len(holds)) - np.searchsorted(np.array([holds[i][0] for i in by_luck]), [holds[i][0] for i in by_luck])
        holds = [holds[i] for i in sorted(by_luck[(place < ALIKE_SWAPS) | (luck[by_luck] < 0)].tolist())]
        swaps = self._swaps(holds, groups, has, text, column, words_with, len(label), r)
        self._fit(text, column, label, scale, swaps, penalty, r)
        self.table = Table(distinct[order], self.weights)
        self.swaps = len(swaps[0])

    @staticmethod
    def _swaps(holds: list[tuple[int, int]], groups: list[np.ndarray], has: dict[int, np.ndarray], text: np.ndarray, column: np.ndarray, words_with: np.ndarray, n: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, where its changes begin, columns, +1 or -1) of the swaps, by text: a word for another of its group, chosen at random, and for none."""
        partners = {int(h): [int(x) for x in g if x != h] for g in groups for h in g}
        first = np.searchsorted(text, np.arange(n + 1))
        docs, begins, columns, signs = [], [0], [], []
        for d, h in holds:
            count = dict(zip(column[first[d] : first[d + 1]].tolist(), words_with[first[d] : first[d + 1]].tolist(), strict=True))
            gone = [c for c in has[h].tolist() if c >= 0 and count.get(c, 0) == 1]
            for partner in (None, partners[h][int(r.integers(len(partners[h])))]):
                come = [] if partner is None else [c for c in has[partner].tolist() if c >= 0 and (c not in count or c in gone)]
                docs.append(d)
                columns += [*gone, *come]
                signs += [-1] * len(gone) + [1] * len(come)
                begins.append(len(columns))
        return np.array(docs, dtype=np.int64), np.array(begins, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(signs, dtype=np.float64)

    def _fit(self, doc: np.ndarray, col: np.ndarray, label: np.ndarray, scale: np.ndarray, swaps: tuple[np.ndarray, ...], penalty: float, r: np.random.Generator) -> None:
        n, m = len(label), len(scale)
        share = np.clip(label.mean(), 0.02, 0.98) if n else 0.5
        cost = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
        w, bias = np.zeros(m), 0.0
        square, square_bias = np.full(m, 1e-3), 1e-3
        first = np.searchsorted(doc, np.arange(n + 1))
        swap_doc, begins, swap_col, sign = swaps
        swap_first = np.searchsorted(swap_doc, np.arange(n + 1))

        def inside(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(number of the range, place) of all places of some ranges."""
            lengths = high - low
            row = np.repeat(np.arange(len(low)), lengths)
            return row, np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

        size = 64
        for _ in range(EPOCHS if n else 0):
            order = r.permutation(n)
            for begin in range(0, n, size):
                some = order[begin : begin + size]
                row, at = inside(first[some], first[some + 1])
                z = np.bincount(row, weights=(w * scale)[col[at]], minlength=len(some)) + bias
                error = (1 / (1 + np.exp(-z)) - label[some]) * cost[some] / len(some)
                grad = scale * np.bincount(col[at], weights=error[row], minlength=m)
                of, which = inside(swap_first[some], swap_first[some + 1])
                if len(which):
                    row, at = inside(begins[which], begins[which + 1])
                    change = np.bincount(row, weights=(w * scale)[swap_col[at]] * sign[at], minlength=len(which))
                    # Each text's swaps weigh as much as the text, however many it has.
                    each = np.bincount(of, minlength=len(some))[of]
                    pull = 2 * penalty * change / (each * len(some))
                    grad += scale * np.bincount(swap_col[at], weights=pull[row] * sign[at], minlength=m)
                square += grad * grad
                w -= RATE * grad / np.sqrt(square)
                w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK / np.sqrt(square), 0)
                square_bias += error.sum() ** 2
                bias -= RATE * error.sum() / np.sqrt(square_bias)
        self.weights, self.bias = w * scale, bias

    def score(self, text: pa.Array) -> np.ndarray:
        doc, hashes = held(text)
        row = self.table.find(hashes)
        z = np.bincount(doc[row >= 0], weights=self.table.values[row[row >= 0]], minlength=len(text)) + self.bias
        return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; labels (doc_id, toxic) outside the held-out fold are learned from.

    Null and empty texts hold no word and get the score of the bias alone; without labelled rows every score is 0.5.
    Repeated rows and rows without an id are scored one by one; null labels and other columns are ignored; of an empty table the
    result is empty. A text is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, known = sample(docs, labels.filter(remainder("doc_id", folds) != fold).select("doc_id", F.col("toxic").cast("int").alias("label")))
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.value.score(text))], names=["doc_id", "score"])

    found = docs.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (remainder("doc_id", folds) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
