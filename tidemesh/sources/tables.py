"""Stored tables as Parquet: reads with their fixed schema, appends by day, and rewrites."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only the columns of the schema; the day partition, where there is one, is read along for pruning. Other partitions, as a stream's epochs, are left out."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])).parquet(path).select(*schema.names, "event_date")


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date(F.timestamp_seconds("timestamp")))


def append(df: DataFrame, path: str) -> None:
    dated(df).write.mode("append").partitionBy("event_date").parquet(path)


def between_days(df: DataFrame, start: float, end: float) -> DataFrame:
    """A time range that prunes partitions as well."""
    day = lambda s: F.to_date(F.timestamp_seconds(F.lit(float(s))))
    return df.filter(F.col("event_date").between(day(start), day(end)) & (F.col("timestamp") >= start) & (F.col("timestamp") <= end))


def columns_of(df: DataFrame) -> DataFrame:
    """position and name of each column."""
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, name string")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; a temporary one only where Spark runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='tidemesh-')}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
