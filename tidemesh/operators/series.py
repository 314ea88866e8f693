"""Time series at several resolutions: rollups, consolidation, gap filling, deltas and the choice of archive.

The round-robin files that these replace interpolate at slot bounds; here a sample belongs to the slot that its time falls in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.functions.codes import COUNTERS, GAUGES, HEARTBEAT, SOURCES, metric_name, type_name
from tidemesh.operators.reads import bound
from tidemesh.operators.summaries import type_stats

STEP = 60
# Fixed values: (consolidation, seconds in a slot, slots kept).
ARCHIVES = (("AVERAGE", 60, 10080), ("AVERAGE", 300, 8640), ("AVERAGE", 3600, 8760), ("MAX", 60, 10080), ("MIN", 60, 10080))
KNOWN_SHARE = 0.5


def sources(spark: SparkSession) -> DataFrame:
    """ds, kind, heartbeat, least, most of all sources: samples beyond the bounds, and after a longer silence than the heartbeat, are unknown."""
    return spark.createDataFrame([(n, kind, HEARTBEAT, low, high) for n, kind, low, high in SOURCES], "ds string, kind string, heartbeat int, least double, most double")


def archives(spark: SparkSession) -> DataFrame:
    """cf, step, slots of all archives."""
    return spark.createDataFrame(list(ARCHIVES), "cf string, step int, slots int")


def slot(seconds: Column, step: int) -> Column:
    return (F.floor(seconds / step) * step).cast("long")


#: Columns of a packet that its sample is made of.
SAMPLED = ("rssi", "snr", "length", "score", "type", "transmitted")


def first_per_second(packets: DataFrame) -> DataFrame:
    """second, id and the sampled columns of the packets that feed a series, the first of each whole second: an aggregation that combines before the shuffle."""
    second = F.floor(F.col("ts_us") / 1_000_000).cast("long").alias("second")
    return packets.groupBy(second).agg(F.min(F.struct("ts_us", "id", *SAMPLED)).alias("first")).select("second", "first.id", *(f"first.{c}" for c in SAMPLED))


def gauge(name: str) -> Column:
    """A gauge's sample, unknown outside of its range."""
    column, low, high = GAUGES[name]
    value = F.col(column).cast("double")
    return F.when(value.between(low, high), value)


def rollup(packets: DataFrame, step: int = STEP) -> DataFrame:
    """bucket_ts, ds, samples, average, least, most of every gauge and the counters' increase: one aggregation over all sources."""
    return rolled_up(first_per_second(packets), step)


def rolled_up(fed: DataFrame, step: int = STEP) -> DataFrame:
    """rollup() of samples as first_per_second() gives them."""
    kinds = {f"type_{i}": F.col("type") == i for i in range(16)} | {"type_other": F.col("type") > 15}
    ones = {"rx_count": F.lit(1.0), "tx_count": F.col("transmitted").cast("double"), "drop_count": 1.0 - F.col("transmitted").cast("double")} | {n: c.cast("double") for n, c in kinds.items()}
    bucket = slot(F.col("second"), step).alias("bucket_ts")
    parts = [x for n in GAUGES for x in (F.count(gauge(n)).alias(f"{n}_n"), F.avg(gauge(n)).alias(f"{n}_avg"), F.min(gauge(n)).alias(f"{n}_min"), F.max(gauge(n)).alias(f"{n}_max"))]
    sums = fed.groupBy(bucket).agg(*parts, *(F.sum(c).alias(f"{n}_sum") for n, c in ones.items()), F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(n).alias("ds"), F.col(f"{n}_n").alias("samples"), F.col(f"{n}_avg").alias("average"), F.col(f"{n}_min").alias("least"), F.col(f"{n}_max").alias("most")) for n in GAUGES]
    rows += [F.struct(F.lit(n).alias("ds"), F.col("n").alias("samples"), F.col(f"{n}_sum").alias("average"), F.col(f"{n}_sum").alias("least"), F.col(f"{n}_sum").alias("most")) for n in ones]
    return sums.select("bucket_ts", F.inline(F.array(*rows)))


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """One rollup of two that hold different samples, of the same slots or not."""
    both = first.unionByName(second)
    is_gauge = F.col("ds").isin(*GAUGES)
    weighted = F.try_divide(F.sum(F.col("average") * F.col("samples")), F.sum(F.when(F.col("average").isNotNull(), F.col("samples"))))
    sums = both.groupBy("bucket_ts", "ds").agg(F.sum("samples").alias("samples"), weighted.alias("mean"), F.sum("average").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    pick = lambda c: F.when(is_gauge, F.col(c)).otherwise(F.col("total"))
    return sums.select("bucket_ts", "ds", "samples", pick("mean").alias("average"), pick("least").alias("least"), pick("most").alias("most"))


def updated(rolled: DataFrame, packets: DataFrame, last_update: int, step: int = STEP) -> DataFrame:
    """A stored rollup with further packets taken in; samples not later than its last one (whole seconds) are skipped, as they come too late or twice."""
    return combined(rolled, rolled_up(first_per_second(packets).filter(F.col("second") > last_update), step))


def consolidated(rolled: DataFrame, step: int = 300, base: int = STEP, share: float = KNOWN_SHARE) -> DataFrame:
    """bucket_ts, ds, known, value: averages of the base slots, null where less than ``share`` of them are known."""
    slots = step // base
    known = F.count(F.when(F.col("samples") > 0, F.col("average")))
    return rolled.groupBy(slot(F.col("bucket_ts"), step).alias("bucket_ts"), "ds").agg(known.alias("known"), F.avg("average").alias("mean")).select("bucket_ts", "ds", "known", F.when(F.col("known") >= slots * share, F.col("mean")).alias("value"))


def gap_filled(values: DataFrame, start: int, end: int, step: int, sources: Sequence[str]) -> DataFrame:
    """bucket_ts, ds, value on the regular grid from start to end, null where there is no value.

    The grid's size is known beforehand, (end - start) / step rows for each source.
    """
    spark = values.sparkSession
    grid = spark.range(start, end, step).select(F.col("id").alias("bucket_ts")).select("bucket_ts", F.explode(F.array(*(F.lit(s) for s in sources))).alias("ds"))
    return grid.join(values.select("bucket_ts", "ds", "value"), ["bucket_ts", "ds"], "left")


def counter_delta(values: DataFrame) -> DataFrame:
    """value's increase over the point before in its source, at least 0; 0 where either is null."""
    before = F.lag("value").over(Window.partitionBy("ds").orderBy("bucket_ts"))
    return values.withColumn("delta", F.when(F.col("value").isNull() | before.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("value") - before)))


def gauge_filled(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.coalesce("value", F.lit(0.0)))


def counter_rate(samples: DataFrame) -> DataFrame:
    """Per second rate of a cumulative counter (ds, ts, value); unknown after a gap of over HEARTBEAT and where the counter fell."""
    w = Window.partitionBy("ds").orderBy("ts")
    gap, rise = F.col("ts") - F.lag("ts").over(w), F.col("value") - F.lag("value").over(w)
    return samples.withColumn("rate", F.when((gap > 0) & (gap <= HEARTBEAT) & (rise >= 0), F.try_divide(rise, gap)))


def archive_for(span_s: float, consolidation: str = "AVERAGE") -> int:
    """Seconds in a slot of the finest archive that still covers the span; the coarsest where none does."""
    steps = sorted((step, step * kept) for cf, step, kept in ARCHIVES if cf == consolidation.upper())
    return next((step for step, covers in steps if span_s <= covers), steps[-1][0])


def fetched(packets: DataFrame, start: int, end: int, consolidation: str = "AVERAGE") -> DataFrame:
    """bucket_ts, ds, value of a time range from the archive that suits it."""
    step = archive_for(end - start, consolidation)
    column = {"AVERAGE": "average", "MIN": "least", "MAX": "most"}[consolidation.upper()]
    time, low = bound(packets, start)
    rolled = rollup(packets.filter((time >= low) & (time < bound(packets, end)[1])), STEP)
    if step == STEP:
        return rolled.select("bucket_ts", "ds", F.col(column).alias("value"))
    return consolidated(rolled, step).select("bucket_ts", "ds", "value")


def selected(names: str, known: Sequence[str]) -> list[str]:
    """The sources a comma-separated list asks for, in its order; ``all`` is every one, unknown names are dropped."""
    return list(known) if names.strip() == "all" else [n for n in (x.strip() for x in names.split(",")) if n in known]


def metrics_graph(packets: DataFrame, start: int, end: int, consolidation: str = "AVERAGE", metrics: str = "all") -> DataFrame:
    """type, name, data ([[ms, value], ...]) of each metric: counters as deltas, gauges with 0 for null."""
    names = selected(metrics, (*COUNTERS, *GAUGES))
    step = archive_for(end - start, consolidation)
    filled = gap_filled(fetched(packets, start, end, consolidation).filter(F.col("ds").isin(*names) if names else F.lit(False)), start - start % step, end, step, names)
    value = F.when(F.col("ds").isin(*COUNTERS), F.col("delta")).otherwise(F.coalesce("value", F.lit(0.0)))
    points = counter_delta(filled).select("ds", F.struct((F.col("bucket_ts") * 1000).alias("ms"), F.round(value, 6).alias("value")).alias("point"))
    data = F.transform(F.array_sort(F.collect_list("point")), lambda p: F.array(p["ms"].cast("double"), p["value"]))
    return points.groupBy("ds").agg(data.alias("data")).select(F.col("ds").alias("type"), metric_name(F.col("ds")).alias("name"), "data")


def type_totals(values: DataFrame, least_points: int = 10) -> DataFrame:
    """ds and total of each source: largest less smallest value of two or more points, the value of one, never below 0.

    Without ``least_points`` known points altogether there is no result, as in the summaries that fall back to counting packets.
    """
    per = values.groupBy("ds").agg(F.count("value").alias("n"), F.max("value").alias("most"), F.min("value").alias("least"))
    enough = values.agg((F.count("value") >= least_points).alias("enough"))
    total = F.when(F.col("n") >= 2, F.col("most") - F.col("least")).when(F.col("n") == 1, F.col("most")).otherwise(0.0)
    return per.join(F.broadcast(enough)).filter("enough").select("ds", F.greatest(F.lit(0.0), total).alias("total"))


def partitioned(values: DataFrame) -> DataFrame:
    """values with the part of a result that each source belongs to: counts of packet types, or metrics."""
    return values.withColumn("part", F.when(F.col("ds").startswith("type_"), "packet_types").otherwise("metrics"))


def type_stats_of_series(packets: DataFrame, hours: float, now: int, least_points: int = 10) -> DataFrame:
    """name, count of each packet type from the series; where that has too few known points, from the packets themselves."""
    values = partitioned(fetched(packets, int(now - hours * 3600), now)).filter("part = 'packet_types'")
    code = F.when(F.col("ds") == "type_other", 16).otherwise(F.substring("ds", 6, 2).cast("int"))
    few = values.agg((F.count("value") < least_points).alias("few"))
    counts = type_stats(packets, hours, now).join(F.broadcast(few)).filter("few")
    return type_totals(values, least_points).select(type_name(code).alias("name"), F.col("total").cast("long").alias("count")).unionByName(counts.select("name", "count"))


def kept(values: DataFrame, step: int, consolidation: str, now: int) -> DataFrame:
    """What an archive's fixed number of slots still holds."""
    slots = next(k for cf, s, k in ARCHIVES if (cf, s) == (consolidation, step))
    return values.filter(F.col("bucket_ts") > now - step * slots)
