"""A queue of messages that readers follow by index, and its form as server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(queue: DataFrame, index: int) -> DataFrame:
    """What a reader that has seen ``index`` messages still gets, in order. queue: seq (from 0, as appended) and payload (JSON text)."""
    return queue.filter(F.col("seq") >= index).orderBy("seq")


def latest(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.desc("seq")).limit(1)


def next_index(queue: DataFrame) -> DataFrame:
    """One row with the index from which a new reader starts."""
    return queue.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("index"))


def event(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def events(queue: DataFrame, index: int) -> DataFrame:
    """seq, event of a reader's poll: what is new or, with nothing new, a sign of life without a number."""
    new = after(queue, index).select("seq", event(F.col("payload")).alias("event"))
    quiet = new.agg((F.count(F.lit(1)) == 0).alias("quiet")).filter("quiet")
    return new.unionByName(quiet.select(F.lit(None).cast("long").alias("seq"), event(F.lit('{"type":"keepalive"}')).alias("event")))
