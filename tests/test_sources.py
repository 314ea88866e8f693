"""Sources and sinks: configuration files, the host, a gauge, a message broker."""

import json
import time

import pytest
from pyspark.sql import functions as F
from tidemesh.operators import publish
from tidemesh.sources import broker, config, host, poller
from tidemesh.streaming import messages


def test_configuration_files(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    with pytest.raises(FileNotFoundError):
        config.load(path)
    assert config.save({"repeater": {"node_name": "hügel"}, "a": [1, 2]}, path) is None
    first = config.load(path)
    assert first["repeater"] == {"node_name": "hügel"} and first["a"] == [1, 2] and len(first["mesh"]["identity_key"]) == 32
    assert config.load(path)["mesh"]["identity_key"] == first["mesh"]["identity_key"]
    monkeypatch.setenv("TIDEMESH_LOG_LEVEL", "DEBUG")
    assert config.load(path)["logging"] == {"level": "DEBUG"}
    kept = config.save({"mesh": {"identity_key": "x"}}, path)
    assert kept.name == "config.yaml.backup" and "hügel" in kept.read_text(encoding="utf-8")
    assert config.load(path)["mesh"] == {"identity_key": "x"}
    assert config.save({"b": 1}, path, backup=False) is None and "hügel" in kept.read_text(encoding="utf-8")


def test_a_value_is_loaded_anew_when_it_is_too_old():
    loads = []
    cached = config.Refreshed(lambda: loads.append(1) or len(loads), ttl_s=60)
    assert [cached.get(t) for t in (0, 30, 60, 60.5, 120, 121)] == [1, 1, 1, 2, 2, 3]


def test_host(spark):
    host.register(spark)
    row = spark.read.format("host").load().first()
    assert 0 <= row.cpu.usage_percent <= 100 and row.cpu["count"] > 0
    assert row.memory.total == row.memory.available + row.memory.used and row.disk.total > 0
    assert row.network.bytes_recv >= 0 and row.system.uptime > 0 and abs(row.system.boot_time + row.system.uptime - row.timestamp) < 1
    rows = spark.read.format("host").option("kind", "processes").load().collect()
    assert rows and all(r.memory_mb >= 0 and 0 <= r.memory_percent <= 100 and r.cpu_percent >= 0 for r in rows)
    assert host._share(1, 0) == 0.0


READINGS = iter([-110.0, None, -111.5, -112.0, *[-113.0] * 1000])


def gauge():
    return next(READINGS)


def test_gauge_reader_keeps_its_interval():
    reader = poller._Reader("tests.test_sources:gauge", 0.05)
    start = reader.initialOffset()
    rows, one = reader.read(start)
    assert [r[1] for r in rows] == [-110.0]
    assert list(reader.read(one)[0]) == [] and reader.read(one)[1] == one
    time.sleep(0.06)
    rows, two = reader.read(one)
    assert list(rows) == [] and two["readings"] == 2
    time.sleep(0.06)
    rows, three = reader.read(two)
    assert [r[1] for r in rows] == [-111.5]
    assert [r[1] for r in reader.readBetweenOffsets(start, three)] == [-110.0, -111.5]
    reader.commit(three)
    assert list(reader.readBetweenOffsets(start, three)) == []


def test_gauge_stream(spark, tmp_path):
    stream = poller.noise_stream(spark, "tests.test_sources:gauge", 0.01)
    q = publish.noise_record(stream, 0.0).writeStream.format("memory").queryName("noise").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 60
        while spark.table("noise").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert spark.table("noise").filter("noise_floor_dbm < -100").count() >= 2


def test_broker(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, name string, note string")
    broker.send(publish.messages(rows, "mesh", "hill", "advert"), folder=str(tmp_path / "m"))
    got = sorted((m["topic"], m["payload"]) for f in (tmp_path / "m").iterdir() for m in map(json.loads, f.read_text().splitlines()))
    assert got == [("mesh/hill/advert", '{"name":"a"}'), ("mesh/hill/advert", '{"name":"b","note":"x"}')]
    with pytest.raises(Exception, match="nowhere"):
        broker.client_of({"client": "nowhere:factory"})


def test_broker_stream(spark, tmp_path):
    broker.register(spark)
    spark.range(5).select(F.lit("t").alias("topic"), F.col("id").cast("string").alias("payload")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("topic string, payload string").parquet(str(tmp_path / "in"))
    stream.writeStream.format("broker").option("folder", str(tmp_path / "m")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(x)["payload"] for f in (tmp_path / "m").iterdir() for x in f.read_text().splitlines()) == list("01234")


def test_messages(spark):
    queue = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(4)], "seq long, payload string")
    assert [r.event for r in messages.events(queue, 2).collect()] == ['data: {"n":2}\n\n', 'data: {"n":3}\n\n']
    assert [(r.seq, r.event) for r in messages.events(queue, 4).collect()] == [(None, 'data: {"type":"keepalive"}\n\n')]
    assert messages.next_index(queue).first()[0] == 4 and messages.next_index(queue.limit(0)).first()[0] == 0
    assert messages.latest(queue).first().seq == 3


def test_failure_and_types(spark):
    assert publish.failure(spark, "no such key").first().response == '{"success":false,"error":"no such key"}'
    assert [r.type for r in publish.disallowed_types(spark, ["req", "Path", "none such"]).collect()] == [0, 8]
    assert publish.own_adverts(spark, {}, 0, 10**6, 0).count() == 0
