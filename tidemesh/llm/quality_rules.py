"""Quality rules as weak supervision.

Each rule votes for or against a document or abstains. The rules' accuracies and the share of good
documents are estimated from all documents' votes by expectation-maximisation (a two-class
Dawid-Skene model with abstentions, each rule with a rate of false alarms and one of detections), and the
posterior probability decides; a rule that is often wrong counts little. Only the counts of the vote patterns, at most 3 ** len(RULES) rows,
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.store import stored

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bare_words", "n_distinct_words")


def text_counts(text: pa.Array, span: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each text of a block."""
    w = K.Words(text)
    n = len(w.offsets) - 1
    head = (w.data & 0xC0) != 0x80
    out = {
        "n_words": w.counts,
        "word_chars": K.sums_by(w.offsets, w.inside & head),
        "n_symbols": K.sums_by(w.offsets, _SYMBOL[w.data]),
        "n_upper": K.sums_by(w.offsets, _UPPER[w.data]),
        "n_letters": K.sums_by(w.offsets, _LETTER[w.data] & head),
    }
    letters = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[w.data], out=letters[1:])
    out["n_bare_words"] = K.sums_by(w.first, letters[w.end] == letters[w.start])
    # Lines end at \n and at the end of a text.
    breaks = np.flatnonzero(w.data == 10)
    bounds = np.union1d(w.offsets, breaks + 1)
    start = np.concatenate([[0], bounds[bounds > 0]])[: len(bounds)]
    end = np.append(start[1:], len(w.data))
    bare = end - ((end > start) & (np.append(w.data, 0)[np.maximum(end - 1, 0)] == 10))
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, bare = start[has], bare[has]
    owner = np.searchsorted(w.offsets, start, side="right") - 1
    codes = K.Rolling(K.byte_codes(w.data), K.BASES[0])
    key = K.mix(codes.ranges(start, bare) ^ K.mix(owner.astype(np.uint64) + np.uint64(1)))
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=n)
    # Runs of words that occur again in their text.
    hashes, of = codes.ranges(w.start, w.end), w.owner()
    word_key = K.mix(hashes ^ K.mix(of.astype(np.uint64) + np.uint64(1)))
    out["n_distinct_words"] = np.bincount(of[np.unique(word_key, return_index=True)[1]], minlength=n)
    grams = K.Rolling(hashes, K.BASES[1]).grams(span)
    whole = np.flatnonzero(of[: len(grams)] == of[span - 1 :][: len(grams)])
    key = K.mix(grams[whole] ^ K.mix(of[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = whole[again]
    out["n_repeat_words"] = K.sums_by(w.first, K.covered(len(hashes), at, at + span))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                counts = text_counts(text)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """1: good, -1: bad, 0: abstains; over the columns of measured()."""
    words, letters = F.col("n_words"), F.col("n_letters")
    of_words = lambda c: F.col(c) / F.greatest(words, F.lit(1))
    of_lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(letters, F.lit(1))
    mean = of_words("word_chars")
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    varied = of_words("n_distinct_words")
    return {
        "length": _vote(words < 20, words >= 60),
        "symbols": _vote(of_words("n_symbols") > 0.2, of_words("n_symbols") < 0.05),
        "letters": _vote(F.col("n_letters") / chars < 0.75, F.col("n_letters") / chars > 0.85),
        "bare_words": _vote(of_words("n_bare_words") > 0.2, of_words("n_bare_words") < 0.1),
        "lines": _vote(of_lines > 0.3, (of_lines < 0.1) & (F.col("n_lines") >= 3)),
        "repeats": _vote(of_words("n_repeat_words") > 0.3, (of_words("n_repeat_words") < 0.05) & (words >= 20)),
        "capitals": _vote(upper > 0.35, upper < 0.15),
        "word_length": _vote((mean < 2.5) | (mean > 12), mean.between(3.0, 9.5)),
        "variety": _vote((words >= 100) & (varied < 0.15), (words >= 100) & (varied > 0.3)),
    }


#: What is believed of a rule before its votes are seen, and how much that weighs against them, in shares of all documents.
FALSE_ALARMS, FALSE_ALARMS_WEIGHT = 0.005, 0.1
DETECTIONS, DETECTIONS_WEIGHT = 0.3, 0.2
#: A rule votes against a good document no more often than so: else a corpus of mostly junk could pass for the good class.
MOST_ALARMS = 0.2
#: Bounds of the share of good documents.
LEAST_GOOD, MOST_GOOD = 0.02, 0.98


def fit(votes: np.ndarray, weights: np.ndarray, rounds: int = 100, least: float = LEAST_GOOD, most: float = MOST_GOOD) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, and each rule's chance to vote against a good one (false alarm) and against a bad one (detection), where it votes.

    votes: pattern by rule; weights: documents of each pattern; least, most: bounds of the share. It starts from the guess that documents with a vote against are bad.
    """
    against, cast = (votes < 0) * weights[:, None], (votes != 0) * weights[:, None]
    n = weights.sum()
    good = np.where((votes < 0).any(1), 0.02, 0.95)
    share, alarm, detect = 0.8, np.full(votes.shape[1], FALSE_ALARMS), np.full(votes.shape[1], DETECTIONS)
    for _ in range(rounds if len(votes) else 0):
        share = float(np.clip((good * weights).sum() / n, least, most))
        alarm = np.minimum((good @ against + FALSE_ALARMS * FALSE_ALARMS_WEIGHT * n) / (good @ cast + FALSE_ALARMS_WEIGHT * n), MOST_ALARMS)
        detect = ((1 - good) @ against + DETECTIONS * DETECTIONS_WEIGHT * n) / ((1 - good) @ cast + DETECTIONS_WEIGHT * n)
        detect = np.maximum(detect, alarm)
        good = posterior(votes, share, alarm, detect)
    return share, alarm, detect


def posterior(votes: np.ndarray, share: float, alarm: np.ndarray, detect: np.ndarray) -> np.ndarray:
    """Probability of each pattern's documents to be good; who abstains says nothing."""
    odds = np.log(share / (1 - share)) + np.where(votes < 0, np.log(alarm / detect), np.where(votes > 0, np.log((1 - alarm) / (1 - detect)), 0.0)).sum(1)
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, COUNTS, each rule's vote (``vote_*``), p_good, base_failed, kept.

    Null and empty texts have no words and fail the base rule. Rows with the same doc_id, or none, are judged one by one;
    further columns are ignored, whatever their names. Of an empty table the result is empty. A text is read whole by one task,
    which needs about 100 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    names = [f"vote_{r}" for r in rules()]
    table = stored(measured(docs).withColumns({f"vote_{r}": v.cast("int") for r, v in rules().items()}), "rules")
    patterns = table.groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in patterns], dtype=float).reshape(-1, len(names))
    fitted = fit(votes, np.array([r["count"] for r in patterns], dtype=float))
    scored = [(*(r[n] for n in names), float(p)) for r, p in zip(patterns, posterior(votes, *fitted), strict=True)]
    by_pattern = spark.createDataFrame(scored, ", ".join(f"{n} int" for n in names) + ", p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return table.join(F.broadcast(by_pattern), names).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))
