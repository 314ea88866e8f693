"""Filters, orders and limits over the stored tables. The clock is always an argument; orders end in the id, so that ties have one result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.schemas import ADVERT_COLUMNS, KEY_COLUMNS, PACKET_COLUMNS


def bound(df: DataFrame, seconds: float) -> tuple[Column, Column]:
    """The time column and the bound in its type: the raw event time where the table has it, as only that is pushed down to Parquet."""
    if "ts" in df.columns:
        return F.col("ts"), F.timestamp_seconds(F.lit(seconds)).cast(df.schema["ts"].dataType)
    return F.col("timestamp"), F.lit(float(seconds))


def since(df: DataFrame, hours: float, now: float) -> DataFrame:
    """Rows later than ``hours`` before now; one exactly at the cutoff is out."""
    time, cutoff = bound(df, now - hours * 3600)
    return df.filter(time > cutoff)


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def scan_packets(packets: DataFrame) -> DataFrame:
    return scan(packets, PACKET_COLUMNS)


def scan_adverts(adverts: DataFrame) -> DataFrame:
    return scan(adverts, ADVERT_COLUMNS).withColumns({c: F.col(c).cast("boolean") for c in ("is_repeater", "is_new_neighbor", "zero_hop")})


def scan_transport_keys(keys: DataFrame) -> DataFrame:
    return scan(keys, KEY_COLUMNS).orderBy("created_at", "id")


def filtered_packets(packets: DataFrame, packet_type: int | None = None, route: int | None = None, start: float | None = None, end: float | None = None, limit: int | None = 1000) -> DataFrame:
    """Newest first; conditions that are None don't hold anything back, time bounds are inclusive."""
    tests: list[Column] = []
    if packet_type is not None:
        tests.append(F.col("type") == packet_type)
    if route is not None:
        tests.append(F.col("route") == route)
    if start is not None:
        time, first = bound(packets, start)
        tests.append(time >= first)
    if end is not None:
        time, last = bound(packets, end)
        tests.append(time <= last)
    return newest(packets.filter(reduce(and_, tests)) if tests else packets, limit)


def newest(df: DataFrame, limit: int | None, time: str = "timestamp") -> DataFrame:
    ordered = df.orderBy(F.desc(time), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def oldest_first(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.orderBy(time, "id")


def packet_by_hash(packets: DataFrame, packet_hash: str) -> DataFrame:
    """The earliest packet with the hash."""
    return packets.filter(F.col("packet_hash") == packet_hash).orderBy("timestamp", "id").limit(1)


def by_id(df: DataFrame, key: int) -> DataFrame:
    return df.filter(F.col("id") == key)


def dropped_with_reason(packets: DataFrame) -> DataFrame:
    return packets.filter(~F.col("transmitted") & F.col("drop_reason").isNotNull())


def adverts_by_contact_type(adverts: DataFrame, contact_type: str, limit: int | None = None, hours: float | None = None, now: float | None = None) -> DataFrame:
    found = adverts.filter(F.col("contact_type") == contact_type)
    if hours is not None:
        found = since(found, hours, now)
    return newest(found, limit)


def answers_discovery(node_type: Column, mask: Column) -> Column:
    """Whether a discovery mask asks for nodes of a type."""
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), node_type)) != 0


def forwards_trace(path_length: Column, path: Column, own_hash: str, seen: Column) -> Column:
    """A trace goes on if its next hop is this node and it isn't a copy."""
    return (path_length < F.size(path)) & (F.get(path, path_length) == own_hash) & ~seen


def no_forward_reason(path_length: Column, path: Column, expected_length: Column, own_hash: str, seen: Column) -> Column:
    return (
        F.when(path_length >= expected_length, "Trace completed")
        .when(F.size(path) <= path_length, "Path index out of bounds")
        .when(F.get(path, path_length) != own_hash, "Not our turn")
        .when(seen, "Duplicate packet")
    )


def valid_packet(payload: Column, path: Column, most_hops: int) -> Column:
    return (F.length(F.coalesce(payload, F.lit(""))) > 0) & (F.coalesce(F.size(path), F.lit(0)) < most_hops)


def recent_ring(packets: DataFrame, size: int = 50) -> DataFrame:
    """The last ``size`` packets that aren't copies, each with its later copies nested: see duplicates_nested.

    The ring's hashes are found by one aggregation; only their packets are nested.
    """
    from tidemesh.operators.entities import duplicates_nested

    first = packets.groupBy("packet_hash").agg(F.min(F.struct(F.col("timestamp").isNull().alias("untimed"), "timestamp", "id")).alias("first"))
    ring = first.orderBy(F.desc("first.timestamp"), F.desc("first.id")).limit(size).select(F.col("packet_hash").alias("held"))
    held = packets.join(F.broadcast(ring), F.col("packet_hash").eqNullSafe(F.col("held")), "left_semi")
    return duplicates_nested(held).orderBy(F.desc("timestamp"), F.desc("id")).limit(size)


def top_by(df: DataFrame, column: str, limit: int = 10, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), key).limit(limit)


def log_ring(records: DataFrame, size: int = 100) -> DataFrame:
    """The last records, oldest first."""
    return newest(records, size).orderBy("timestamp", "id")


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
