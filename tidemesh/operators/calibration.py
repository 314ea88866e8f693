"""The channel-activity grid: combinations of two thresholds, their order of trial, and the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First peak and first minimum tried for each spreading factor; eight of each, in steps of one.
FIRST_PEAK = {7: 22, 8: 22, 9: 24, 10: 26, 11: 28, 12: 30}
FIRST_MIN = {7: 12, 8: 12, 9: 14, 10: 16, 11: 18, 12: 20}
STEPS = 8
IDEAL = (10.0, 30.0)


def grid(spark: SparkSession, spreading_factor: int = 8) -> DataFrame:
    """det_peak, det_min, distance from the grid's centre: 64 rows."""
    peak, least = FIRST_PEAK.get(spreading_factor, FIRST_PEAK[8]), FIRST_MIN.get(spreading_factor, FIRST_MIN[8])
    steps = lambda start: F.explode(F.sequence(F.lit(start), F.lit(start + STEPS - 1)))
    both = spark.range(1).select(steps(peak).alias("det_peak")).select("det_peak", steps(least).alias("det_min"))
    middle = (STEPS - 1) / 2
    distance = F.sqrt(F.pow(F.col("det_peak") - (peak + middle), 2) + F.pow(F.col("det_min") - (least + middle), 2))
    return both.withColumn("distance", distance)


def centre_out(cells: DataFrame) -> DataFrame:
    """Cells with their place from the centre out; ties by the thresholds."""
    return cells.withColumn("place", F.row_number().over(Window.orderBy("distance", "det_peak", "det_min")))


def banded(cells: DataFrame, bands: int = 8, seed: int = 1) -> DataFrame:
    """centre_out() in equal bands, shuffled inside each by a seeded hash."""
    ranked = centre_out(cells).withColumn("band", F.floor((F.col("place") - 1) * bands / (STEPS * STEPS)).cast("int"))
    return ranked.withColumn("trial", F.row_number().over(Window.orderBy("band", F.xxhash64("det_peak", "det_min", F.lit(seed)))))


def best(results: DataFrame) -> DataFrame:
    """One row: the cell of the highest score within the ideal band of rates, or of all where none lies in it. results: det_peak, det_min, adjusted_rate, sensitivity_score."""
    cell = F.struct("det_peak", "det_min", "adjusted_rate", "sensitivity_score")
    rank = F.struct(F.col("sensitivity_score"), -F.col("det_peak"), -F.col("det_min"))
    inside = F.col("adjusted_rate").between(*IDEAL)
    picked = results.agg(F.coalesce(F.max_by(F.when(inside, cell), F.when(inside, rank)), F.max_by(cell, rank)).alias("best"), F.count_if(inside).alias("ideal_cells"))
    return picked.select("best.*", "ideal_cells")
