"""Publishing to a message broker as a Python data source, for batches and streams: one message for each row of topic and payload.

The client is named by the option ``client``, "module:factory": factory(options) returns an object with publish(topic, payload) and close().
Without it messages are appended to files in the folder of the option ``folder``, one file for each task, which readers can follow.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


class FolderClient:
    """Messages as JSON lines; for tests, and for brokers that pick files up."""

    def __init__(self, options: Mapping[str, str]) -> None:
        os.makedirs(options["folder"], exist_ok=True)
        self.file = open(os.path.join(options["folder"], f"{uuid.uuid4().hex}.jsonl"), "w", encoding="utf-8")  # noqa: SIM115

    def publish(self, topic: str, payload: str) -> None:
        self.file.write(json.dumps({"topic": topic, "payload": payload}) + "\n")

    def close(self) -> None:
        self.file.close()


def client_of(options: Mapping[str, str]):
    if "client" not in options:
        return FolderClient(options)
    module, factory = options["client"].split(":")
    return getattr(importlib.import_module(module), factory)(options)


def _sent(options: Mapping[str, str], rows: Iterator) -> WriterCommitMessage:
    client = client_of(options)
    try:
        for row in rows:
            client.publish(row["topic"], row["payload"])
    finally:
        client.close()
    return WriterCommitMessage()


class _Writer(DataSourceWriter):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _sent(self.options, iterator)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _sent(self.options, iterator)


class BrokerSink(DataSource):
    """df.write.format("broker").mode("append").option(...).save(); a retried task sends its messages again (at least once)."""

    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "topic string, payload string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BrokerSink)


def send(messages: DataFrame, **options: str) -> None:
    """Publishes rows of topic and payload."""
    register(messages.sparkSession)
    messages.select("topic", F.col("payload").cast("string")).write.format("broker").options(**options).mode("append").save()
