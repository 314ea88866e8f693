"""Sessions with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "tidemesh") -> SparkSession.Builder:
    """Adaptive execution on, session time zone UTC; all else is the cluster's choice."""
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
