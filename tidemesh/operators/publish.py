"""Records as they are published, and what may be."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.functions.codes import TYPE_CODES

# Reasons for which a packet isn't published.
INVALID_REASONS = ("Invalid advert packet", "Empty payload", "Path too long")


def iso(timestamp: Column) -> Column:
    """ISO time in the session's zone; microseconds only where there are any."""
    at = F.timestamp_micros(F.round(timestamp * 1_000_000).cast("long"))
    return F.when(F.unix_micros(at) % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def published(packets: DataFrame, origin: str, origin_id: str) -> DataFrame:
    """Seventeen texts for each packet that has its raw bytes."""
    at = F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("long"))
    text = lambda c: F.col(c).cast("string")
    return packets.filter(F.length("raw_packet") > 0).select(
        F.lit(origin).alias("origin"),
        F.lit(origin_id).alias("origin_id"),
        iso(F.col("timestamp")).alias("timestamp"),
        F.lit("PACKET").alias("type"),
        F.lit("rx").alias("direction"),
        F.date_format(at, "HH:mm:ss").alias("time"),
        F.date_format(at, "d/M/yyyy").alias("date"),
        F.floor(F.length("raw_packet") / 2).cast("string").alias("len"),
        text("type").alias("packet_type"),
        F.when(F.col("route") == 1, "F").when(F.col("route") == 2, "D").otherwise(text("route")).alias("route"),
        text("payload_length").alias("payload_len"),
        F.col("raw_packet").alias("raw"),
        text("snr").alias("SNR"),
        text("rssi").alias("RSSI"),
        (F.col("score") * 1000).cast("int").cast("string").alias("score"),
        F.lit("0").alias("duration"),
        F.col("packet_hash").alias("hash"),
    )


def admitted(packets: DataFrame, disallowed: DataFrame | None = None, skip_invalid: bool = True) -> DataFrame:
    """Packets that may be published: of a type that is known and not in ``disallowed`` (type), with raw bytes, not invalid."""
    out = packets.filter(F.col("type").isNotNull() & (F.length(F.coalesce("raw_packet", F.lit(""))) > 0))
    if skip_invalid:
        out = out.filter(F.col("drop_reason").isNull() | ~F.col("drop_reason").isin(*INVALID_REASONS))
    return out if disallowed is None else out.join(disallowed.select("type").distinct(), "type", "left_anti")


def as_json(df: DataFrame) -> DataFrame:
    """id and the row as JSON; null fields are left out."""
    return df.select("id", F.to_json(F.struct(*(c for c in df.columns if c != "id"))).alias("payload"))


def topic(base: str, node: str, kind: str) -> str:
    return f"{base}/{node}/{kind}"


def stored_form(records: DataFrame, now: float) -> DataFrame:
    """Records as they are appended: defaults for what is missing, flags as 0 or 1, lists as JSON text."""
    return records.select(
        F.coalesce("timestamp", F.lit(float(now))).alias("timestamp"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("type", "route", "length")),
        *(F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("transmitted", "is_duplicate")),
        "drop_reason",
        F.to_json("original_path").alias("original_path"),
        "packet_hash",
    )


def noise_record(samples: DataFrame, now: float) -> DataFrame:
    """Noise samples as they are appended: without a reading there is no row."""
    return samples.filter(F.col("noise_floor_dbm").isNotNull()).select(F.coalesce("timestamp", F.lit(float(now))).alias("timestamp"), F.col("noise_floor_dbm").cast("double").alias("noise_floor_dbm"))


def messages(df: DataFrame, base: str, node: str, kind: str) -> DataFrame:
    """id, topic, payload of each row as it goes to a broker: null fields are left out."""
    return as_json(df).withColumn("topic", F.lit(topic(base, node, kind)))


def utc_iso(now: float) -> str:
    """ISO time with the offset of UTC."""
    return datetime.fromtimestamp(now, UTC).isoformat()


def wrapped(records: DataFrame, origin_id: str, now: float) -> DataFrame:
    """Records for a broker of many nodes: with the time of sending and the node's id, unless they have their own."""
    added = {"timestamp": utc_iso(now), "origin_id": origin_id}
    return records.select(*(F.lit(v).alias(k) for k, v in added.items() if k not in records.columns), "*")


def raw_records(packets: DataFrame) -> DataFrame:
    """A packet's bytes alone."""
    return packets.filter(F.length("raw_packet") > 0).select("id", F.lit("raw").alias("type"), F.col("raw_packet").alias("data"), F.floor(F.length("raw_packet") / 2).cast("int").alias("bytes"))


def status(counters: DataFrame, node: str, origin_id: str, now: float, started: float, state: str = "online", model: str = "", version: str = "", client: str = "", radio: str = "", location: tuple[float, float] | None = None) -> DataFrame:
    """The heartbeat, one row. counters: one row with rx_count and forwarded_count."""
    stats = F.struct(F.lit(int(now - started)).alias("uptime_secs"), F.col("forwarded_count").alias("packets_sent"), F.col("rx_count").alias("packets_received"), F.lit(0).alias("errors"), F.lit(0).alias("queue_len"))
    texts = {"status": state, "timestamp": utc_iso(now), "origin": node, "origin_id": origin_id, "model": model, "firmware_version": version, "radio": radio, "client_version": client}
    place = [F.struct(F.lit(location[0]).alias("latitude"), F.lit(location[1]).alias("longitude")).alias("location")] if location else []
    return counters.select(*(F.lit(v).alias(k) for k, v in texts.items()), stats.alias("stats"), *place)


def disallowed_types(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The codes (type) of packet types by their short names, in any case; unknown names are dropped."""
    codes = sorted({TYPE_CODES[n.upper()] for n in names if n.upper() in TYPE_CODES})
    return spark.createDataFrame([(c,) for c in codes], "type int")


def own_adverts(spark: SparkSession, node: Mapping, start: int, end: int, every_hours: float) -> DataFrame:
    """The adverts that a node sends itself, one every ``every_hours`` from start to end (none if that is 0).

    packet_hash stands for each one's hash, by which the node marks it as seen before it can come back: see entities.already_seen().
    """
    step = int(every_hours * 3600)
    times = spark.range(start, end, step, 1) if step > 0 else spark.range(0)
    sent = F.col("id").cast("double")
    fields = {"pubkey": "", "node_name": "Repeater", "latitude": 0.0, "longitude": 0.0} | dict(node)
    hashed = F.upper(F.substring(F.md5(F.concat(F.lit(f"{fields['pubkey']}:"), F.col("id").cast("string")).cast("binary")), 1, 16))
    return times.select(sent.alias("timestamp"), *(F.lit(v).alias(k) for k, v in fields.items()), F.lit(True).alias("is_repeater"), F.lit("REPEATER").alias("contact_type"), F.lit(1).alias("route_type"), hashed.alias("packet_hash"))


def envelope(rows: DataFrame, order: str = "id") -> DataFrame:
    """A response in one row: success, the rows in order and their number, as JSON. For results that are limited already."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct("*").alias("row")))), lambda x: x["row"])
    return rows.agg(F.to_json(F.struct(F.lit(True).alias("success"), listed.alias("data"), F.count(F.lit(1)).alias("count"))).alias("response"))


def failure(spark: SparkSession, message: str) -> DataFrame:
    return spark.range(1).select(F.to_json(F.struct(F.lit(False).alias("success"), F.lit(message).alias("error"))).alias("response"))
