"""The corpus pipeline: language ID, near duplicates, repeated passages, source mix, packing.

run(spark, sf_dir) applies STAGES to the documents; each stage's result is written as Parquet in the folder shared by
the cluster and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm import jaccard, kernel, language, mixing, packing, store, substring_dedup
from tidemesh.llm.spans import ROW, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if no language scores as much. With four languages a guess has 0.25.
LEAST_SCORE = 0.3


def _documents(df: DataFrame) -> DataFrame:
    store.small_batches(df.sparkSession)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language: those of ``und`` and of a score below LEAST_SCORE go; lang becomes the prediction.

    Null, empty and letterless texts go. Rows are judged one by one, also those that share a doc_id.
    """
    found = language.identify(_documents(docs), keep=("text", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id.

    A null doc_id comes after all others and is kept as null. Rows that share a doc_id (or have none) are documents of their own:
    where they are near duplicates the one with the smallest hash of its text stays, else each is judged by its own
    group. Rows without words are duplicates of nothing and stay.
    """
    docs = _documents(docs)
    rows = store.stored(jaccard.grouped(docs).filter("did = component").select(*ROW, "root"), "near-firsts")
    one = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*", F.lit(False).alias("alone"))
    alone = rows.filter("root IS NULL").select(*ROW, F.lit(True).alias("alone")).distinct()
    held = docs.select("*", *row_key()).join(one.union(alone), ROW)
    # Of equal rows one is left, unless they have no words.
    held = held.withColumn("own", F.when(F.col("alone"), F.monotonically_increasing_id())).groupBy(*ROW, "own")
    held = held.agg(F.first("text").alias("text"), F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("r"))
    return held.select("r.doc_id", "text", "r.lang", "r.source", "r.n_chars")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words and more that an earlier document holds out of the texts; documents without other words go.

    A text that loses nothing stays as it is, another becomes its remaining words joined by spaces. Each row loses what its own
    text repeats; rows that share a doc_id aren't compared with each other. A null doc_id comes after all others and is kept as null.
    """
    cut = substring_dedup.dedup(_documents(docs), keep=("text", "lang", "source"))
    return cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).filter(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document's words as often as the mix takes them: a text is cut after its last word taken, and what is taken again follows it.

    Documents of which nothing is taken go. Rows that share a doc_id, or have none, are documents of their own, each cut by what is
    taken of it: rows are numbered, and the numbers kept, before they are mixed.
    """
    docs = store.stored(_documents(docs).withColumn("number", F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(docs, keep=("number",))[0].filter("taken > 0").select("number", "taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in kernel.blocks(batch):
                w = kernel.Words(text)
                raw, first = w.data.tobytes(), w.first.tolist()
                out = []
                for i, n in enumerate(rows.column(batch.schema.get_field_index("taken")).to_pylist()):
                    at, size, whole, parts = first[i], first[i + 1] - first[i], raw[w.offsets[i] : w.offsets[i + 1]], []
                    while n > 0 and size:
                        m = min(n, size)
                        parts.append(whole if m == size else whole[: w.end[at + m - 1] - w.offsets[i]])
                        n -= m
                    out.append(b"\n".join(parts).decode())
                yield pa.RecordBatch.from_arrays([*(rows.column(batch.schema.get_field_index(c)) for c in ("doc_id", "lang", "source")), pa.array(out, type=pa.string())], names=["doc_id", "lang", "source", "text"])

    joined = docs.join(taken, "number").select("doc_id", "lang", "source", "text", "taken")
    return joined.mapInArrow(run, "doc_id long, lang string, source string, text string").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(_documents(docs))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed),
]
#: SQL knows neither the tokenizer nor the language model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed mix of the documents. Each stage's tables are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with store.scratch(spark) as tables:
            docs = tables.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
