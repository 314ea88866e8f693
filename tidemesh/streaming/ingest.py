"""The packet stream: derive, drop copies, append, keep node and counter tables, publish.

Streams of files stand for the radio's queue; any source of the same columns does. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemesh.operators import series
from tidemesh.operators.entities import merged
from tidemesh.operators.publish import admitted, as_json, messages, published
from tidemesh.sources.tables import dated, remove

LATE = "10 minutes"


def packet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Packets as they arrive, with event_time for watermarks (the stored time has no zone, which watermarks refuse)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("event_time", F.timestamp_seconds("timestamp"))


def with_local(stream: DataFrame, injected: DataFrame) -> DataFrame:
    """The radio's packets and those the node makes itself, which forwarding rules don't hold back."""
    return stream.withColumn("local", F.lit(False)).unionByName(injected.withColumn("local", F.lit(True)))


def first_copies(stream: DataFrame, late: str = LATE) -> DataFrame:
    """The first packet of each hash within the watermark. State expires between batches, so this is no exact time to live; see exact_copies()."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["packet_hash"])


def exact_copies(stream: DataFrame, ttl_s: float = 60.0, late: str = LATE) -> DataFrame:
    """packet_hash, id, timestamp, admitted: copies up to ttl_s after the last admission, exact for packets that arrive in order of time."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["timestamp", "id"])
        out = []
        for ident, at in zip(rows["id"], rows["timestamp"], strict=True):
            fresh = last is None or at - last > ttl_s
            last = at if fresh else last
            out.append((key[0], ident, at, fresh))
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["packet_hash", "id", "timestamp", "admitted"])

    keyed = stream.withWatermark("event_time", late).groupBy("packet_hash")
    return keyed.applyInPandasWithState(judge, "packet_hash string, id long, timestamp double, admitted boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, step: str = "60 seconds", late: str = LATE) -> DataFrame:
    """Packets, sent packets and mean SNR of each slot, closed once the watermark passes."""
    slots = stream.withWatermark("event_time", late).groupBy(F.window("event_time", step))
    return slots.agg(F.count(F.lit(1)).alias("rx"), F.count_if("transmitted").alias("tx"), F.avg("snr").alias("avg_snr")).select(F.unix_timestamp("window.start").alias("bucket_ts"), "rx", "tx", "avg_snr")


def scheduled(stream: DataFrame, delay_s) -> DataFrame:
    """When a packet is to be sent: delayed emission as a column, for whatever sends."""
    return stream.withColumn("scheduled_ts", F.col("timestamp") + delay_s)


#: Versions of a node table that are kept: a batch that is run again reads the one before its own.
VERSIONS = 3


def run_of(batch: DataFrame) -> str:
    """The streaming query's id, which its checkpoint keeps; batches run by hand have one in common."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(version, run, epoch) of a table's versions, from its folders' names."""
    try:
        rows = spark.read.parquet(path).select("version", "run", "epoch").distinct().collect()
    except Exception as e:  # no version yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return []
    return sorted((r.version, str(r.run), r.epoch) for r in rows)


def node_table(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The newest version of a table that every batch writes anew, or the newest below a given one."""
    found = [v for v, *_ in _versions(spark, path) if below is None or v < below]
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]}").select(*schema.names) if found else spark.createDataFrame([], schema)


def upsert_adverts(path: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """A batch function that merges adverts into the node table as its next version.

    A batch that is run again writes its own version again, from the one before it. A new checkpoint goes on from the table that is there.
    Old versions are removed.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark, query = batch.sparkSession, run_of(batch)
        there = _versions(spark, path)
        own = next((v for v, r, e in there if (r, e) == (query, epoch)), None)
        version = own if own is not None else there[-1][0] + 1 if there else 0
        merged(node_table(spark, path, schema, version), batch).write.mode("overwrite").parquet(f"{path}/version={version}/run={query}/epoch={epoch}")
        for old in {v for v, *_ in there if v <= version - VERSIONS}:
            remove(spark, f"{path}/version={old}")

    return run


def series_table(spark: SparkSession, path: str) -> DataFrame:
    """The rollup that update_series() keeps: what all batches added, put together."""
    parts = spark.read.parquet(path).drop("last_second", "run", "epoch")
    return series.combined(parts, parts.limit(0))


def update_series(path: str, step: int = series.STEP) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the batch's samples to a rollup; samples not later than the last of the batches before come too late and are skipped."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark, query = batch.sparkSession, run_of(batch)
        try:
            before = spark.read.parquet(path).filter((F.col("run") != query) | (F.col("epoch") < epoch)).agg(F.max("last_second")).first()[0]
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = None
        if "ts_us" not in batch.columns:
            batch = batch.withColumn("ts_us", F.round(F.col("timestamp") * 1_000_000).cast("long"))
        fed = series.first_per_second(batch)
        fed = (fed if before is None else fed.filter(F.col("second") > before)).persist()
        try:
            last = fed.agg(F.max("second")).first()[0]
            series.rolled_up(fed, step).withColumn("last_second", F.lit(before if last is None else last).cast("long")).write.mode("overwrite").parquet(f"{path}/run={query}/epoch={epoch}")
        finally:
            fed.unpersist()

    return run


def fan_out(packets_path: str, published_path: str, origin: str, origin_id: str, disallowed: DataFrame | None = None, series_path: str | None = None, send: Callable[[DataFrame], None] | None = None, base: str = "mesh") -> Callable[[DataFrame, int], None]:
    """A batch function with several sinks, in this order: the packet table, the series, messages for a broker, and the records that may be published as JSON.

    Tables have a folder for each epoch, which a batch that is run again overwrites; ``send`` gets rows of topic and payload, again in that case.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.drop("event_time").persist()
        try:
            dated(batch).write.mode("overwrite").partitionBy("event_date").parquet(f"{packets_path}/run={run_of(batch)}/epoch={epoch}")
            if series_path is not None:
                update_series(series_path)(batch, epoch)
            if send is not None:
                send(messages(published(batch, origin, origin_id).withColumn("id", F.lit(epoch)), base, origin, "packet").select("topic", "payload"))
            records = published(admitted(batch, disallowed), origin, origin_id).withColumn("id", F.lit(epoch))
            as_json(records).write.mode("overwrite").parquet(f"{published_path}/run={run_of(batch)}/epoch={epoch}")
        finally:
            batch.unpersist()

    return run


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch function over a stream: over what is there if once, else every 5 s."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
