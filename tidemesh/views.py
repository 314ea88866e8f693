"""The stored tables, derived from the ``events``, ``region`` and ``nation`` test tables.

Everything is whole numbers or exact fractions, so another engine gets the same values. NOW stands for the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.functions.signal import airtime_ms, packet_score
from tidemesh.functions.text import hex_byte, path_text

NOW = 1_706_659_200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a pattern that matches it alone, as streams take patterns and folders but no single file."""
    return spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet")


def _clock(df: DataFrame) -> DataFrame:
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return df.withColumn("ts_us", ts_us).withColumn("timestamp", ts_us / 1_000_000.0)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(events(spark, sf_dir))


def packets_of(df: DataFrame) -> DataFrame:
    """The packets table of events, read or streamed."""
    e, u = F.col("event_id"), F.col("user_id")
    hops = F.transform(F.sequence(F.lit(0).cast("long"), e % 11 - 1), lambda i: hex_byte((u * 7 + e + i) % 256))
    path = F.when(e % 11 != 0, hops)
    sent = F.col("event_type").isin("click", "view", "purchase")
    payload = F.lower(F.substring(F.md5(e.cast("string").cast("binary")), 1, 24))
    header = ((e % 18) % 16 * 4 + u % 4).cast("int")
    return _clock(df).select(
        e.alias("id"),
        "ts",
        "ts_us",
        "timestamp",
        (e % 18).cast("int").alias("type"),
        (u % 6).cast("int").alias("route"),
        (1 + u % 200).cast("int").alias("length"),
        (-40 - u % 80).cast("int").alias("rssi"),
        ((e % 161) / 4.0 - 20.0).alias("snr"),
        packet_score((e % 161) / 4.0 - 20.0, 1 + u % 200).alias("score"),
        sent.alias("transmitted"),
        (F.col("event_type") == "error").alias("is_duplicate"),
        F.when(F.col("event_type") == "error", "Duplicate").when((F.col("event_type") == "signup") & (u % 2 == 0), "Direct: not for us").alias("drop_reason"),
        hex_byte(u % 256).alias("src_hash"),
        hex_byte(e % 256).alias("dst_hash"),
        path_text(path).alias("path_hash"),
        F.format_string("0x%02X", header).alias("header"),
        F.lit(None).cast("string").alias("transport_codes"),
        payload.alias("payload"),
        (1 + u % 200).cast("int").alias("payload_length"),
        (F.col("value") * 10.0).alias("tx_delay_ms"),
        F.upper(F.substring(F.md5((e % 5000).cast("string").cast("binary")), 1, 16)).alias("packet_hash"),
        path.alias("original_path"),
        F.when(sent, F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array(F.lit("AB")))).alias("forwarded_path"),
        F.concat(F.lower(F.format_string("%02X", header)), payload).alias("raw_packet"),
        airtime_ms(1 + u % 200, 8, 62_500).alias("airtime_ms"),
    )


def advert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adverts_of(events(spark, sf_dir))


def adverts_of(df: DataFrame) -> DataFrame:
    """The adverts of events, read or streamed."""
    u = F.col("user_id")
    kind = F.when(F.col("event_type") == "click", "REPEATER").when(F.col("event_type") == "view", "CHAT").when(F.col("event_type") == "purchase", "ROOM_SERVER").when(F.col("event_type") == "signup", "SENSOR").otherwise("UNKNOWN")
    return _clock(df).select(
        F.col("event_id").alias("id"),
        "ts",
        "ts_us",
        "timestamp",
        F.md5(u.cast("string").cast("binary")).alias("pubkey"),
        F.concat(F.lit("node-"), u.cast("string")).alias("node_name"),
        F.upper(kind).contains("REPEATER").alias("is_repeater"),
        (u % 6).cast("int").alias("route_type"),
        kind.alias("contact_type"),
        ((u % 180) - 90.0).alias("latitude"),
        ((u % 360) - 180.0).alias("longitude"),
        (-40 - u % 80).cast("int").alias("rssi"),
        ((F.col("event_id") % 161) / 4.0 - 20.0).alias("snr"),
        (u % 6).isin(2, 3).alias("zero_hop"),
    )


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(events(spark, sf_dir)).select(F.col("event_id").alias("id"), "ts", "ts_us", "timestamp", (-120.0 + (F.col("event_id") % 100) / 4.0).alias("noise_floor_dbm"))


def transport_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keys(df: DataFrame, number: str, first: int, name: str, parent) -> DataFrame:
        n = F.col(number).cast("long")
        return df.select(
            (first + n).alias("id"),
            F.col(name).alias("name"),
            F.when(n % 2 == 0, "allow").otherwise("deny").alias("flood_policy"),
            F.md5(F.col(name).cast("binary")).alias("transport_key"),
            F.when(n % 3 == 0, NOW - n * 60.0).alias("last_used"),
            parent.cast("long").alias("parent_id"),
            (NOW - 86400.0 + first + n).alias("created_at"),
            (NOW - 86400.0 + first + n).alias("updated_at"),
        )

    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    return keys(region, "r_regionkey", 1, "r_name", F.lit(None)).union(keys(nation, "n_nationkey", 100, "n_name", 1 + F.col("n_regionkey")))


#: The same views for DuckDB, as common table expressions.
SQL = """
packets AS (
    SELECT event_id AS id, ts, epoch_us(ts) AS ts_us, epoch_us(ts) / 1000000.0 AS timestamp,
        CAST(event_id % 18 AS INTEGER) AS type, CAST(user_id % 6 AS INTEGER) AS route, CAST(1 + user_id % 200 AS INTEGER) AS length,
        CAST(-40 - user_id % 80 AS INTEGER) AS rssi, (event_id % 161) / 4.0 - 20.0 AS snr,
        CASE WHEN (event_id % 161) / 4.0 - 20.0 < -10.0 THEN 0.0
             ELSE greatest(0.0, least(1.0, ((event_id % 161) / 4.0 - 20.0 + 10.0) / 10.0 * (1.0 - (1 + user_id % 200) / 256.0))) END AS score,
        event_type IN ('click', 'view', 'purchase') AS transmitted, event_type = 'error' AS is_duplicate,
        CASE WHEN event_type = 'error' THEN 'Duplicate' WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'Direct: not for us' END AS drop_reason,
        printf('%02X', user_id % 256) AS src_hash, printf('%02X', event_id % 256) AS dst_hash,
        printf('0x%02X', (event_id % 18) % 16 * 4 + user_id % 4) AS header, CAST(NULL AS VARCHAR) AS transport_codes,
        substr(md5(CAST(event_id AS VARCHAR)), 1, 24) AS payload, CAST(1 + user_id % 200 AS INTEGER) AS payload_length, value * 10.0 AS tx_delay_ms,
        upper(substr(md5(CAST(event_id % 5000 AS VARCHAR)), 1, 16)) AS packet_hash,
        CASE WHEN event_id % 11 <> 0 THEN list_transform(range(0, event_id % 11), lambda i: printf('%02X', (user_id * 7 + event_id + i) % 256)) END AS original_path,
        lower(printf('%02X', (event_id % 18) % 16 * 4 + user_id % 4)) || substr(md5(CAST(event_id AS VARCHAR)), 1, 24) AS raw_packet,
        8 * 256 / 62.5 + (1 + user_id % 200 + 4.25) * 8 * (256 / 62.5) AS airtime_ms
    FROM events
), advert_events AS (
    SELECT event_id AS id, ts, epoch_us(ts) AS ts_us, epoch_us(ts) / 1000000.0 AS timestamp, md5(CAST(user_id AS VARCHAR)) AS pubkey,
        'node-' || CAST(user_id AS VARCHAR) AS node_name, event_type = 'click' AS is_repeater, CAST(user_id % 6 AS INTEGER) AS route_type,
        CASE event_type WHEN 'click' THEN 'REPEATER' WHEN 'view' THEN 'CHAT' WHEN 'purchase' THEN 'ROOM_SERVER' WHEN 'signup' THEN 'SENSOR' ELSE 'UNKNOWN' END AS contact_type,
        user_id % 180 - 90.0 AS latitude, user_id % 360 - 180.0 AS longitude, CAST(-40 - user_id % 80 AS INTEGER) AS rssi,
        (event_id % 161) / 4.0 - 20.0 AS snr, user_id % 6 IN (2, 3) AS zero_hop
    FROM events
), noise_floor AS (
    SELECT event_id AS id, ts, epoch_us(ts) / 1000000.0 AS timestamp, -120.0 + (event_id % 100) / 4.0 AS noise_floor_dbm FROM events
), transport_keys AS (
    SELECT CAST(1 + r_regionkey AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'allow' ELSE 'deny' END AS flood_policy, md5(r_name) AS transport_key,
        CASE WHEN r_regionkey % 3 = 0 THEN 1706659200 - r_regionkey * 60.0 END AS last_used, CAST(NULL AS BIGINT) AS parent_id,
        1706659200 - 86400.0 + 1 + r_regionkey AS created_at, 1706659200 - 86400.0 + 1 + r_regionkey AS updated_at FROM region
    UNION ALL
    SELECT CAST(100 + n_nationkey AS BIGINT), n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'allow' ELSE 'deny' END, md5(n_name),
        CASE WHEN n_nationkey % 3 = 0 THEN 1706659200 - n_nationkey * 60.0 END, CAST(1 + n_regionkey AS BIGINT),
        1706659200 - 86400.0 + 100 + n_nationkey, 1706659200 - 86400.0 + 100 + n_nationkey FROM nation
)
"""
