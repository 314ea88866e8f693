"""Bounded samples of labelled texts for fitting classifiers on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh.llm.store import stored

#: A sample has at most so many documents and, taken in the order of their hash, bytes of text.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 24 << 20


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, list]:
    """(texts, labels) of documents that ``labels`` (doc_id, label) names: those of the smallest hashes of their id, up to the bounds.

    Null texts and labels and single texts beyond ``most_bytes`` are left out, and don't count against the bounds; ids with several
    labels or texts count once, with the largest label and the smallest text.
    """
    texts = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).select(F.col("doc_id").alias("own_id"), "text")
    named = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    named = named.join(texts.select(F.col("own_id").alias("doc_id")), "doc_id", "left_semi")
    named = named.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(most_docs)
    found = texts.join(F.broadcast(named), F.col("own_id") == F.col("doc_id")).groupBy("key", "doc_id", "label").agg(F.min("text").alias("text"))
    found = stored(found.withColumn("bytes", F.octet_length("text")), "sample")
    total, last = 0, None
    for r in found.select("key", "bytes").orderBy("key", "doc_id").collect():
        total += r["bytes"]
        if total > most_bytes:
            break
        last = r["key"]
    rows = found.filter(F.col("key") <= F.lit(last)).select("text", "label").orderBy("key", "doc_id").collect() if last is not None else []
    return pa.array([r["text"] for r in rows], type=pa.large_string()), [r["label"] for r in rows]
