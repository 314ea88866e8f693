"""Streams over files, run until all is read, against their batch twins."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidemesh import views as V
from tidemesh.operators import entities, series, stateful
from tidemesh.sources import tables
from tidemesh.streaming import ingest

from tests.conftest import SF


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrivals") / "files")
    p = V.packets(spark, SF).drop("ts", "airtime_ms").withColumn("packet_hash", F.concat(F.lit("h"), F.col("id") % 300))
    p.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    # Streams read files by age; names are in order of time.
    for i, f in enumerate(sorted(Path(path).glob("part-*"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return path, spark.read.parquet(path)


def test_fan_out(spark, arrivals, tmp_path):
    path, batch = arrivals
    stream = ingest.packet_stream(spark, path, batch.schema)
    q = ingest.start(stream, ingest.fan_out(str(tmp_path / "p"), str(tmp_path / "j"), "n", "k"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p")).count() == batch.count() == spark.read.parquet(str(tmp_path / "j")).count()


def test_node_table(spark, tmp_path):
    a = V.advert_events(spark, SF).drop("ts", "ts_us")
    a.repartitionByRange(3, "timestamp").write.parquet(str(tmp_path / "a"))
    want = entities.advert_upsert(a)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    ingest.start(stream, ingest.upsert_adverts(str(tmp_path / "t"), want.schema), str(tmp_path / "c")).awaitTermination()
    got = ingest.node_table(spark, str(tmp_path / "t"), want.schema)
    key = lambda df: sorted((r.pubkey, r.advert_count, r.first_seen, r.last_seen, r.contact_type) for r in df.collect())
    assert key(got) == key(want)


def test_exact_copies_equal_the_batch_fold(spark, arrivals, tmp_path):
    path, batch = arrivals
    ttl = 5 * 86400.0
    q = ingest.exact_copies(ingest.packet_stream(spark, path, batch.schema, 4), ttl).writeStream.format("memory").queryName("copies").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.admitted for r in spark.table("copies").collect()}
    want = {r.id: r.admitted for r in stateful.dedup_ttl(batch, ttl).collect()}
    assert got == want


def test_windowed_counts_and_first_copies(spark, arrivals, tmp_path):
    path, batch = arrivals
    for name, make in (("slots", lambda s: ingest.windowed_counts(s, "3600 seconds")), ("firsts", lambda s: ingest.first_copies(s).select("id", "packet_hash"))):
        q = make(ingest.packet_stream(spark, path, batch.schema, 4)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r.bucket_ts: r.n for r in batch.groupBy(series.slot(F.col("timestamp"), 3600).alias("bucket_ts")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.bucket_ts: r.rx for r in spark.table("slots").collect()}
    assert got and all(want[b] == n for b, n in got.items()) and len(want) - len(got) <= 2
    assert spark.table("firsts").count() == batch.select("packet_hash").distinct().count()


def test_local_packets_and_schedule(spark):
    p = V.packets(spark, SF).select("id", "timestamp")
    both = ingest.with_local(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"))
    assert both.filter("local").count() == p.filter("id % 2 = 1").count()
    assert ingest.scheduled(p, F.lit(2.0)).filter("scheduled_ts <> timestamp + 2").isEmpty()
    assert tables.columns_of(p).count() == 2


class Stopped(Exception):
    """A batch that fails after it has written, so that its epoch is run again."""


def twice(function, failing):
    """function, which fails behind its own work at epoch ``failing`` the first time."""
    done = []

    def run(batch, epoch):
        function(batch, epoch)
        if epoch == failing and not done:
            done.append(epoch)
            raise Stopped

    return run


def run_twice(stream, function, checkpoint, failing):
    run = twice(function, failing)
    q = ingest.start(stream, run, checkpoint)
    with pytest.raises(Exception, match="Stopped"):
        q.awaitTermination()
    ingest.start(stream, run, checkpoint).awaitTermination()


def test_a_repeated_epoch_changes_nothing(spark, arrivals, tmp_path):
    path, batch = arrivals
    a = V.advert_events(spark, SF).drop("ts", "ts_us")
    a.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "a"))
    want = entities.advert_upsert(a)
    adverts = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    key = lambda df: sorted((r.pubkey, r.advert_count, r.first_seen, r.last_seen, r.contact_type) for r in df.collect())
    for failing in (0, 2):
        run_twice(adverts, ingest.upsert_adverts(str(tmp_path / f"t{failing}"), want.schema), str(tmp_path / f"ct{failing}"), failing)
        assert key(ingest.node_table(spark, str(tmp_path / f"t{failing}"), want.schema)) == key(want)
        assert len(ingest._versions(spark, str(tmp_path / f"t{failing}"))) <= ingest.VERSIONS + 1

        out = {n: str(tmp_path / f"{n}{failing}") for n in ("p", "j", "s", "c")}
        run_twice(ingest.packet_stream(spark, path, batch.schema), ingest.fan_out(out["p"], out["j"], "n", "k", series_path=out["s"]), out["c"], failing)
        assert spark.read.parquet(out["p"]).count() == batch.count() == spark.read.parquet(out["j"]).count()
        assert tables.read(spark, out["p"], batch.schema).columns == [*batch.columns, "event_date"]
        rolled = lambda df: sorted((r.bucket_ts, r.ds, r.samples, None if r.average is None else round(r.average, 6)) for r in df.collect())
        assert rolled(ingest.series_table(spark, out["s"])) == rolled(series.rollup(batch))


def test_a_new_checkpoint_goes_on_from_the_table(spark, tmp_path):
    a = V.advert_events(spark, SF).drop("ts", "ts_us")
    want = entities.advert_upsert(a)
    for name, part in (("one", a.filter("id % 2 = 0")), ("two", a.filter("id % 2 = 1"))):
        part.write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / name))
        ingest.start(stream, ingest.upsert_adverts(str(tmp_path / "t"), want.schema), str(tmp_path / f"c-{name}")).awaitTermination()
    got = ingest.node_table(spark, str(tmp_path / "t"), want.schema)
    assert {r.pubkey: r.advert_count for r in got.collect()} == {r.pubkey: r.advert_count for r in want.collect()}


def test_late_samples_are_skipped(spark):
    p = V.packets(spark, SF)
    whole = series.rollup(p)
    last = int(p.selectExpr("max(floor(ts_us / 1000000))").first()[0])
    same = lambda df: sorted((r.bucket_ts, r.ds, r.samples) for r in df.collect())
    assert same(series.updated(whole, p, last)) == same(whole)
