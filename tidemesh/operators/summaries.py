"""Counts, averages and histograms of packets and noise samples, each in one pass over its rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.functions.codes import route_name, slug, type_name
from tidemesh.functions.signal import percent_of_budget
from tidemesh.operators.reads import dropped_with_reason, latest_per_key, newest, recent_ring, since


def rounded_mean(column: str, digits: int, half_even: bool = False) -> Column:
    """The mean, 0 where there is none. Ties round up, or to the even digit."""
    return (F.bround if half_even else F.round)(F.coalesce(F.avg(column), F.lit(0.0)), digits)


def packet_stats(packets: DataFrame, hours: float, now: float, half_even: bool = False) -> DataFrame:
    """One row. The two sums are null where there is no packet, the means 0; half_even: see rounded_mean()."""
    sent = F.col("transmitted").cast("long")
    return since(packets, hours, now).agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.sum(sent).alias("transmitted_packets"),
        F.sum(1 - sent).alias("dropped_packets"),
        rounded_mean("rssi", 1, half_even).alias("avg_rssi"),
        rounded_mean("snr", 1, half_even).alias("avg_snr"),
        rounded_mean("score", 3, half_even).alias("avg_score"),
        rounded_mean("payload_length", 1, half_even).alias("avg_payload_length"),
        rounded_mean("tx_delay_ms", 1, half_even).alias("avg_tx_delay"),
    )


def histogram(df: DataFrame, key: str, hours: float, now: float) -> DataFrame:
    """Rows by key, most frequent first."""
    return since(df, hours, now).groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)


def drop_reasons(packets: DataFrame, hours: float, now: float) -> DataFrame:
    return histogram(dropped_with_reason(packets), "drop_reason", hours, now)


def _bucketed(packets: DataFrame, column: str, label: Column, last: int, hours: float, now: float) -> DataFrame:
    bucket = F.least(F.col(column), F.lit(last + 1))
    counts = since(packets, hours, now).filter(F.col(column) >= 0).groupBy(bucket.alias("code")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("code", label.alias("name"), "count").orderBy("code")


def type_stats(packets: DataFrame, hours: float, now: float) -> DataFrame:
    """Packets by type; types above 15 in one bucket, negative ones nowhere, empty buckets left out."""
    return _bucketed(packets, "type", type_name(F.col("code")), 15, hours, now)


def route_stats(packets: DataFrame, hours: float, now: float) -> DataFrame:
    return _bucketed(packets, "route", route_name(F.col("code")), 3, hours, now)


def type_graph(packets: DataFrame, hours: float, now: float) -> DataFrame:
    """type_stats() as bars: one point [end in ms, count] each, highest first."""
    return type_stats(packets, hours, now).select("name", slug(F.col("name")).alias("type"), F.lit(int(now) * 1000).alias("end_ms"), "count").orderBy(F.desc("count"), "name")


def cumulative_counts(packets: DataFrame) -> DataFrame:
    """One row with all-time totals and the count of each type, zeros included."""
    kinds = {f"type_{i}": F.count_if(F.col("type") == i) for i in range(16)} | {"type_other": F.count_if(F.col("type") > 15)}
    totals = {"rx_total": F.count(F.lit(1)), "tx_total": F.count_if("transmitted"), "drop_total": F.count_if(~F.col("transmitted"))}
    return packets.agg(*(c.alias(n) for n, c in (totals | kinds).items()))


def running_counts(packets: DataFrame, part_s: int = 3600) -> DataFrame:
    """Each packet's cumulative received, sent and dropped counts, in order of time and id.

    Hours are summed first, so that a window never holds more than one hour's packets, or all hours' sums.
    """
    part = F.floor(F.col("ts_us") / (part_s * 1_000_000)).alias("part")
    ones = {"rx": F.lit(1), "tx": F.col("transmitted").cast("long"), "dropped": 1 - F.col("transmitted").cast("long")}
    rows = packets.select("id", "timestamp", "ts_us", part, *(c.alias(n) for n, c in ones.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(*(F.sum(n).alias(n) for n in ones)).select("part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ones))
    within = Window.partitionBy("part").orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(parts, "part").select("id", "timestamp", *((F.col(f"{n}_before") + F.sum(n).over(within)).cast("long").alias(f"{n}_total") for n in ones))


def noise_stats(noise: DataFrame, hours: float, now: float) -> DataFrame:
    value = F.col("noise_floor_dbm")
    return since(noise, hours, now).agg(
        F.count(F.lit(1)).alias("measurement_count"),
        rounded_mean("noise_floor_dbm", 1).alias("avg_noise_floor"),
        F.round(F.coalesce(F.min(value), F.lit(0.0)), 1).alias("min_noise_floor"),
        F.round(F.coalesce(F.max(value), F.lit(0.0)), 1).alias("max_noise_floor"),
    )


def noise_history(noise: DataFrame, hours: float, now: float) -> DataFrame:
    return since(noise, hours, now).orderBy("timestamp", "id").select("id", "timestamp", "noise_floor_dbm")


def hourly_rates(packets: DataFrame, now: float, ring: int | None = None) -> DataFrame:
    """Packets received and sent on in the last hour; with ``ring`` only those among the last so many that aren't copies, as a node counts that remembers no more."""
    if ring is not None:
        held = recent_ring(packets, ring).select("id")
        packets = packets.join(F.broadcast(held), "id", "left_semi")
    return since(packets, 1, now).agg(F.count(F.lit(1)).alias("rx_per_hour"), F.count_if("transmitted").alias("forwarded_per_hour"))


def airtime_use(packets: DataFrame, now: float, window_s: float = 60.0, budget_ms: float = 3600.0) -> DataFrame:
    """Sent airtime of the last window, its share of the budget, and the lifetime total."""
    sent = packets.filter("transmitted")
    recent = F.sum(F.when((F.col("timestamp") > now - window_s) & (F.col("timestamp") <= now), F.col("airtime_ms")))
    used = F.coalesce(recent, F.lit(0.0))
    return sent.agg(F.round(used, 3).alias("current_airtime_ms"), F.round(percent_of_budget(used, budget_ms), 3).alias("utilization_percent"), F.round(F.coalesce(F.sum("airtime_ms"), F.lit(0.0)), 3).alias("total_airtime_ms"))


def node_stats(packets: DataFrame, adverts: DataFrame, now: float) -> DataFrame:
    """The live summary in one row: lifetime counters, rates, airtime and the number of known neighbours."""
    counters = packets.agg(F.count(F.lit(1)).alias("rx_count"), F.count_if("transmitted").alias("forwarded_count"), F.count_if(~F.col("transmitted")).alias("dropped_count"))
    neighbours = adverts.agg(F.count_distinct("pubkey").alias("neighbor_count"))
    out = counters
    for one_row in (hourly_rates(packets, now), airtime_use(packets, now), neighbours):
        out = out.join(F.broadcast(one_row))
    return out


# Settings that the live summary shows, by section, and their defaults.
SHOWN = {
    "repeater": {"mode": "forward", "use_score_for_tx": False, "score_threshold": 0.3, "send_advert_interval_hours": 10, "latitude": 0.0, "longitude": 0.0},
    "radio": {"frequency": 0, "tx_power": 0, "bandwidth": 0, "spreading_factor": 0, "coding_rate": 0, "preamble_length": 0},
    "duty_cycle": {"enforcement_enabled": True},
    "delays": {"tx_delay_factor": 1.0, "direct_tx_delay_factor": 0.5},
}


def shown_settings(settings: Mapping) -> Column:
    """The settings of the live summary as one struct; what is missing has its default."""
    own = lambda section: settings.get(section) or {}
    section = lambda name, more: F.struct(*(F.lit(own(name).get(k, d)).alias(k) for k, d in SHOWN[name].items()), *more).alias(name)
    percent = F.lit(own("duty_cycle").get("max_airtime_per_minute", 3600) / 60_000 * 100).alias("max_airtime_percent")
    return F.struct(F.lit(own("repeater").get("node_name", "Unknown")).alias("node_name"), *(section(n, [percent] if n == "duty_cycle" else []) for n in SHOWN))


def live_stats(packets: DataFrame, adverts: DataFrame, noise: DataFrame, settings: Mapping, now: float, started: float, own_hash: int, cache_ttl: int = 60, ring: int = 50, neighbours: int | None = None) -> DataFrame:
    """The whole live summary in one row: node_stats() with rates over the ring, the ring itself, the known nodes, newest first, noise and settings.

    The nodes are one map, which one task builds and which isn't broadcast; ``neighbours`` bounds it to the newest so many.
    """
    recent = recent_ring(packets, ring).agg(F.reverse(F.array_sort(F.collect_list(F.struct("timestamp", "id", "packet_hash", "type", "rssi", "snr", "duplicate_count")))).alias("recent_packets"))
    latest = latest_per_key(adverts.filter(F.col("pubkey").isNotNull()), "pubkey", [F.desc("timestamp"), F.desc("id")])
    if neighbours is not None:
        latest = newest(latest, neighbours)
    node = F.struct("node_name", "contact_type", "timestamp", "rssi", "snr", "zero_hop").alias("node")
    nodes = F.sort_array(F.collect_list(F.struct("timestamp", "id", "pubkey", node)), asc=False)
    known = latest.agg(F.map_from_entries(F.transform(nodes, lambda x: F.struct(x["pubkey"], x["node"]))).alias("neighbors"))
    floor = newest(noise, 1).agg(F.max("noise_floor_dbm").alias("noise_floor_dbm"))
    seen = packets.agg(F.count_distinct("packet_hash").alias("duplicate_cache_size"))
    parts = [node_stats(packets, adverts, now).drop("rx_per_hour", "forwarded_per_hour"), hourly_rates(packets, now, ring), recent, known, floor, seen]
    out = known
    for one_row in parts:
        if one_row is not known:
            out = out.join(F.broadcast(one_row))
    out = out.select(*(c for one_row in parts for c in one_row.columns))
    return out.select(F.lit(f"0x{own_hash:02x}").alias("local_hash"), F.lit(cache_ttl).alias("cache_ttl"), F.lit(float(now - started)).alias("uptime_seconds"), "*", shown_settings(settings).alias("config"))


def detection_rates(samples: DataFrame) -> DataFrame:
    """Per pair of thresholds: detection and baseline percentages and their difference, at least 0. samples: det_peak, det_min, detected, baseline (booleans)."""
    rate = lambda c: F.avg(F.col(c).cast("double")) * 100
    rates = samples.groupBy("det_peak", "det_min").agg(F.count(F.lit(1)).alias("samples"), F.count_if("detected").alias("detections"), rate("detected").alias("detection_rate"), rate("baseline").alias("baseline_rate"))
    return rates.withColumn("adjusted_rate", F.greatest(F.lit(0.0), F.col("detection_rate") - F.col("baseline_rate")))
