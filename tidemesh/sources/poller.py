"""A gauge that is read again and again, as a stream: the noise floor of the radio, or any other number.

The gauge is named by the option ``gauge``, "module:function"; the function returns a number, or None where there is none.
A reading can't be had again: after a restart the stream goes on with new ones.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

INTERVAL_S = 30.0


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, gauge: str, interval_s: float) -> None:
        module, name = gauge.split(":")
        self.gauge = getattr(importlib.import_module(module), name)
        self.interval_s = interval_s
        self.taken: dict[int, tuple[float, float]] = {}

    def initialOffset(self) -> dict:
        return {"readings": 0, "at": 0.0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.time()
        if now - start["at"] < self.interval_s:
            return iter(()), start
        number, value = start["readings"] + 1, self.gauge()
        end = {"readings": number, "at": now}
        if value is None:
            return iter(()), end
        self.taken[number] = (now, float(value))
        return iter([self.taken[number]]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.taken[i] for i in range(start["readings"] + 1, end["readings"] + 1) if i in self.taken])

    def commit(self, end: dict) -> None:
        self.taken = {i: x for i, x in self.taken.items() if i > end["readings"]}


class GaugeSource(DataSource):
    """spark.readStream.format("gauge").option("gauge", "module:function").option("interval", seconds)."""

    @classmethod
    def name(cls) -> str:
        return "gauge"

    def schema(self) -> str:
        return "timestamp double, noise_floor_dbm double"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["gauge"], float(self.options.get("interval", INTERVAL_S)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GaugeSource)


def noise_stream(spark: SparkSession, gauge: str, interval_s: float = INTERVAL_S) -> DataFrame:
    register(spark)
    return spark.readStream.format("gauge").option("gauge", gauge).option("interval", str(interval_s)).load()


def due(spark: SparkSession, start: int, end: int, interval_s: int = int(INTERVAL_S), check_s: int = 5) -> DataFrame:
    """at, due: the checks of a timer from start to end and whether one finds its interval over, the first one always."""
    every = -(-interval_s // check_s) * check_s
    return spark.range(start, end, check_s).select(F.col("id").alias("at"), ((F.col("id") - start) % every == 0).alias("due"))
