"""Single operators on hand-built rows: one case for each trap of the stored data."""

import math

import pytest
from pyspark.sql import functions as F
from tidemesh.functions import codes, signal, text
from tidemesh.operators import calibration, decisions, entities, publish, reads, series, stateful, summaries
from tidemesh.sources import config, host, tables


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(*columns).first()


PACKET = "id long, timestamp double, transmitted boolean, rssi int, snr double, score double, payload_length int, tx_delay_ms double, type int, route int, drop_reason string"


def packets(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PACKET)


def row(ts, sent=True, rssi=-60, snr=1.0, score=0.5, n=10, delay=1.0, kind=0, route=1, reason=None):
    return float(ts), sent, rssi, snr, score, n, delay, kind, route, reason


def test_summary_of_no_rows_and_of_nulls(spark):
    r = summaries.packet_stats(packets(spark), 1, 1000).first()
    assert (r.total_packets, r.transmitted_packets, r.dropped_packets, r.avg_rssi) == (0, None, None, 0.0)
    r = summaries.packet_stats(packets(spark, *(row(999, rssi=None) for _ in range(3))), 1, 1000).first()
    assert (r.total_packets, r.avg_rssi) == (3, 0.0)


def test_cutoffs(spark):
    p = packets(spark, row(6400), row(6400.5), row(10000))
    assert [r.id for r in reads.since(p, 1, 10000).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in reads.filtered_packets(p, start=6400, end=10000).collect()] == [2, 1, 0]
    assert [r.id for r in reads.filtered_packets(p, limit=1).collect()] == [2]
    assert entities.retained(p, 3600 / 86400, 10000).count() == 3


def test_unnamed_codes_share_a_bucket(spark):
    p = packets(spark, row(1, kind=16, route=4), row(1, kind=17, route=5), row(1, kind=-1, route=0))
    assert {r.name: r["count"] for r in summaries.type_stats(p, 1, 2).collect()} == {"Other Types (>15)": 2}
    assert {r.name: r["count"] for r in summaries.route_stats(p, 1, 2).collect()} == {"Other Routes (>3)": 2, "Transport Flood": 1}
    assert one(spark, codes.slug(F.lit("Other Types (>15)")).alias("x"), a=1).x == "other_types_>15"


def test_dropped_without_a_reason(spark):
    p = packets(spark, row(1, sent=False), row(1, sent=False, reason="x"))
    assert summaries.packet_stats(p, 1, 2).first().dropped_packets == 2
    assert [r["count"] for r in summaries.drop_reasons(p, 1, 2).collect()] == [1]


@pytest.mark.parametrize(("snr", "n", "sf", "want"), [(-10.0, 0, 8, 0.0), (-10.25, 0, 8, 0.0), (40.0, 0, 8, 1.0), (5.0, 64, 6, 0.0), (0.0, 128, 8, 0.5)])
def test_score(spark, snr, n, sf, want):
    assert one(spark, signal.packet_score(F.col("snr"), F.col("n"), sf).alias("x"), snr=snr, n=n).x == want


@pytest.mark.parametrize(("snr", "want"), [(14.5, 58), (4.8, 19), (-3.3, 243), (40.0, 127), (-40.0, 128)])
def test_snr_byte(spark, snr, want):
    assert one(spark, signal.snr_byte(F.col("snr")).alias("x"), snr=snr).x == want


@pytest.mark.parametrize(("hops", "want"), [(0, None), (8, "[" + ", ".join(["0A"] * 8) + "]"), (9, "[" + ", ".join(["0A"] * 8) + ", ...]")])
def test_path_text(spark, hops, want):
    path = F.array(*[F.lit("0A")] * hops).cast("array<string>")
    assert one(spark, text.path_text(path).alias("x"), a=1).x == want


def test_texts(spark):
    r = one(spark, text.payload_type(F.lit(0x15)).alias("a"), text.header_text(F.lit(0x15)).alias("b"), text.radio_text(F.lit(869.5), F.lit(62.5), F.lit(8), F.lit(8)).alias("c"), text.parsed_time(F.lit("no")).alias("d"), text.source_hash(F.lit(4), F.lit("ab")).alias("e"), x=1)
    assert tuple(r) == (5, "0x15", "869.5,62.5,8,8", None, "AB")


def test_counter_delta(spark):
    values = spark.createDataFrame([("d", i, v) for i, v in enumerate((5.0, 9.0, None, 20.0, 18.0, 30.0))], "ds string, bucket_ts long, value double")
    assert [r.delta for r in series.counter_delta(values).orderBy("bucket_ts").collect()] == [0, 4, 0, 0, 0, 12]


def test_known_share(spark):
    slots = [(60 * i, "a", 1 if i < 2 else 0, 1.0 if i < 2 else None) for i in range(5)] + [(60 * i, "b", 1 if i < 3 else 0, 2.0 if i < 3 else None) for i in range(5)]
    got = {r.ds: r.value for r in series.consolidated(spark.createDataFrame(slots, "bucket_ts long, ds string, samples long, average double")).collect()}
    assert got == {"a": None, "b": 2.0}


def test_rates_across_gaps_and_falls(spark):
    rows = [("d", 0.0, 0.0), ("d", 60.0, 60.0), ("d", 181.0, 70.0), ("d", 200.0, 5.0)]
    got = [r.rate for r in series.counter_rate(spark.createDataFrame(rows, "ds string, ts double, value double")).orderBy("ts").collect()]
    assert got == [None, 1.0, None, None]


def test_gauges_and_seconds(spark):
    rows = [(0, 0, 5, 31.0), (1, 400_000, -50, 3.0), (2, 1_000_000, -50, 3.0)]
    p = spark.createDataFrame(rows, "id long, ts_us long, rssi int, snr double").withColumns({"length": F.lit(1), "score": F.lit(0.5), "type": F.lit(0), "transmitted": F.lit(True)})
    assert [r.id for r in series.first_per_second(p).orderBy("id").collect()] == [0, 2]
    got = {r.ds: (r.samples, r.average) for r in series.rollup(p).collect()}
    assert got["avg_rssi"] == (1, -50.0) and got["avg_snr"] == (1, 3.0) and got["rx_count"] == (2, 2.0)


def test_archives():
    assert [series.archive_for(d * 86400) for d in (1, 7, 8, 30, 31, 400)] == [60, 60, 300, 300, 3600, 3600]
    assert series.archive_for(400 * 86400, "max") == 60
    assert series.selected(" b,x, a", ["a", "b"]) == ["b", "a"] and series.selected("all", ["a"]) == ["a"]


def _admitted(df):
    return [r.admitted for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("times", "want"), [((0, 40, 70), [True, False, True]), ((0, 60, 60.001), [True, False, True])])
def test_dedup_ttl(spark, times, want):
    p = spark.createDataFrame([(i, float(t), "h") for i, t in enumerate(times)], "id long, timestamp double, packet_hash string")
    assert _admitted(stateful.dedup_ttl(p)) == want


def test_dedup_fifo(spark):
    rows = [(i, float(i), "n", f"h{i}") for i in range(1001)] + [(1001, 1001.0, "n", "h0"), (1002, 1002.0, "n", "h1000")]
    got = _admitted(stateful.dedup_fifo(spark.createDataFrame(rows, "id long, timestamp double, node string, packet_hash string"), "node"))
    assert got[-2:] == [True, False]


def test_duty_cycle_counts_only_what_was_admitted(spark):
    rows = [(0, 0.0, "n", 60.0), (1, 10.0, "n", 60.0), (2, 20.0, "n", 40.0), (3, 60.0, "n", 60.0)]
    df = spark.createDataFrame(rows, "id long, timestamp double, node string, airtime_ms double")
    got = stateful.duty_cycle(df, "node", 100.0).orderBy("id").collect()
    assert [r.admitted for r in got] == [True, False, True, True] and got[1].wait_s == 50.0
    assert stateful.duty_cycle(df.withColumn("airtime_ms", F.lit(200.0)), "node", 100.0).first().wait_s == 1.0
    assert all(_admitted(stateful.duty_cycle(df, "node", 1.0, enforced=False)))


def test_folds_equal_a_model_over_many_keys_and_batches(spark):
    import random

    r = random.Random(0)
    rows = [(i, r.uniform(0, 5000), f"h{r.randrange(40)}") for i in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x.id: x.admitted for x in stateful.dedup_ttl(spark.createDataFrame(rows, "id long, timestamp double, packet_hash string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for i, t, h in sorted(rows, key=lambda x: x[1]):
        fresh = h not in last or t - last[h] > 60
        if fresh:
            last[h] = t
        assert got[i] == fresh


def test_rolling_airtime_leaves_out_what_is_just_old_enough(spark):
    day = 86_400_000_000
    rows = [(0, 0, 1.0), (1, 60_000_000, 2.0), (2, 119_999_999, 4.0), (3, day - 1, 8.0), (4, day + 5, 16.0)]
    df = spark.createDataFrame(rows, "id long, ts_us long, airtime_ms double")
    want = [1.0, 2.0, 6.0, 8.0, 24.0]
    assert [r.window_airtime_ms for r in stateful.rolling_airtime(df).orderBy("id").collect()] == want
    assert [r.window_airtime_ms for r in stateful.rolling_airtime(df.withColumn("n", F.lit(1)), key="n").orderBy("id").collect()] == want


def test_latest_neighbour_ties_and_new_ones(spark):
    rows = [(1, 5.0, "a"), (2, 5.0, "a"), (3, 1.0, "b")]
    a = spark.createDataFrame(rows, "id long, timestamp double, pubkey string")
    assert [(r.pubkey, r.id) for r in entities.neighbors_latest(a).collect()] == [("a", 2), ("b", 3)]
    assert [r.pubkey for r in entities.first_seen_neighbors(a, a.filter("id = 1")).collect()] == ["b"]


def test_update_keeps_what_is_null(spark):
    keys = spark.createDataFrame([(1, "a", "allow", "k", None, None, 0.0, 0.0)], "id long, name string, flood_policy string, transport_key string, last_used double, parent_id long, created_at double, updated_at double")
    r = entities.updated(keys, spark.createDataFrame([(1, None, 7.0)], "id long, name string, last_used double"), 9).first()
    assert (r.name, r.last_used, r.updated_at) == ("a", 7.0, 9.0)
    assert entities.key_violations(entities.updated(keys, spark.createDataFrame([(1, "maybe")], "id long, flood_policy string"), 9)).first().problem == "unknown policy"


def test_transport_key_limit(spark):
    keys = spark.range(5).select("id", F.col("id").cast("string").alias("name"), F.lit("allow").alias("flood_policy"), F.lit("k").alias("transport_key"), F.lit(0.0).alias("created_at"))
    coded = spark.createDataFrame([(1, "3"), (2, "9"), (3, None)], "id long, transport_code string")
    got = {r.id: r.verdict for r in entities.match_transport_key(coded, keys, F.col("key_id").cast("string")).collect()}
    assert got == {1: "allow", 2: "none"}
    with pytest.raises(ValueError):
        entities.match_transport_key(coded, keys, F.col("key_id").cast("string"), most_keys=4)


@pytest.mark.parametrize(("route", "payload", "path", "more", "want"), [
    (1, "", [], {}, "Empty payload"), (1, "aa", ["01"] * 64, {}, "Path length 64 exceeds MAX_PATH_SIZE (64)"), (2, "", [], {}, "Direct: no path"), (2, "", ["02"], {}, "Direct: not for us"), (2, "", ["AB"], {}, None),
    (1, "aa", [], {"seen": True}, "Duplicate"), (2, "aa", ["AB"], {"seen": True}, None), (7, "aa", [], {}, "Unknown route type: 7"), (1, "aa", [], {"over_budget": True}, "Duty cycle limit"),
    (1, "aa", [], {"monitor": True}, "Monitor mode"), (1, "", [], {"local": True}, None), (1, "aa", [], {"flood_allowed": False, "denied": "No matching transport code"}, "No matching transport code"),
    (1, "aa", [], {"preset": "Invalid advert packet"}, "Invalid advert packet"),
])
def test_decisions(spark, route, payload, path, more, want):
    df = spark.createDataFrame([(route, payload, path)], "route int, payload string, original_path array<string>")
    more = {k: v if k in ("monitor", "flood_allowed") else F.lit(v) for k, v in more.items()}
    assert df.select(decisions.drop_reason("AB", 64, **more).alias("x")).first().x == want


def test_publication(spark):
    p = spark.createDataFrame([(1, 4, "aa", None), (2, 1, None, None), (3, None, "aa", None), (4, 1, "aa", "Empty payload"), (5, 1, "aa", "Duplicate")], "id long, type int, raw_packet string, drop_reason string")
    none = spark.createDataFrame([(4,)], "type int")
    assert [r.id for r in publish.admitted(p, none).collect()] == [5]
    assert sorted(r.id for r in publish.admitted(p, skip_invalid=False).collect()) == [1, 4, 5]
    assert one(spark, publish.iso(F.lit(0.0)).alias("a"), publish.iso(F.lit(0.25)).alias("b"), x=1) == ("1970-01-01T00:00:00", "1970-01-01T00:00:00.250000")
    assert publish.as_json(p.filter("id = 2")).first().payload == '{"type":1}'
    assert publish.topic("a", "b", "packet") == "a/b/packet"


def test_calibration(spark):
    cells = calibration.banded(calibration.grid(spark, 9))
    assert cells.count() == 64 and cells.agg(F.min("det_peak"), F.max("det_min")).first() == (24, 21)
    assert [r["count"] for r in cells.groupBy("band").count().collect()] == [8] * 8
    results = spark.createDataFrame([(1, 1, 50.0, 90.0), (2, 2, 20.0, 80.0), (3, 3, 15.0, 70.0)], "det_peak int, det_min int, adjusted_rate double, sensitivity_score double")
    assert calibration.best(results).first().det_peak == 2
    assert calibration.best(results.filter("det_peak = 1")).first().det_peak == 1


def test_delay(spark):
    d = lambda **k: one(spark, signal.tx_delay_s(F.col("route"), F.col("air"), F.col("draw"), F.col("score"), damp=k.pop("damp", False)).alias("x"), **({"route": 1, "air": 1000.0, "draw": 1.0, "score": 0.5} | k)).x
    assert d() == pytest.approx(0.52) and d(damp=True) == pytest.approx(0.26) and d(route=2) == 0.5 and d(draw=5.0, air=9000.0) == 5.0 and d(score=1.0, damp=True) == pytest.approx(0.104)


def test_tables_by_day(spark, tmp_path):
    from tidemesh.schemas import NOISE_FLOOR

    path = str(tmp_path / "noise")
    tables.append(spark.createDataFrame([(1, 10.0, -100.0), (2, 90000.0, -90.0)], NOISE_FLOOR), path)
    tables.append(spark.createDataFrame([(3, 90001.0, -80.0)], NOISE_FLOOR), path)
    found = tables.between_days(tables.read(spark, path, NOISE_FLOOR), 86400, 90000.0)
    assert [r.id for r in found.collect()] == [2]
    assert "PartitionFilters: [isnotnull(event_date" in found._jdf.queryExecution().toString()


def test_config(spark, tmp_path, monkeypatch):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}
    monkeypatch.setenv("X_HOST", "h")
    assert config.from_environment({}, {"X_HOST": ("a", "b")}) == {"a": {"b": "h"}}
    assert config.coerced({"hours": "3"}, {"hours": 24, "limit": None}) == {"hours": 3, "limit": None}
    assert config.lookup({"a": {"b": None}}, "a.b") == "" and config.lookup({"a": {"b": 2}}, "a.b") == 2
    f = tmp_path / "presets.json"
    f.write_text('{"config": {"suggested_radio_settings": {"entries": [{"title": "EU", "frequency": "869.5"}]}}}')
    assert config.radio_presets(spark, str(f)).first().title == "EU"


def test_host_source(spark):
    host.register(spark)
    r = spark.read.format("host").load().first()
    assert r.cpu["count"] > 0 and r.memory["total"] >= r.memory["used"] > 0
    assert reads.top_by(spark.read.format("host").option("kind", "processes").load(), "cpu_seconds", 3, "pid").count() == 3


def test_totals_need_enough_points(spark):
    values = spark.createDataFrame([(i, "type_0", float(i)) for i in range(10)] + [(0, "type_1", 4.0), (0, "type_2", None)], "bucket_ts long, ds string, value double")
    assert {r.ds: r.total for r in series.type_totals(values).collect()} == {"type_0": 9.0, "type_1": 4.0, "type_2": 0.0}
    assert series.type_totals(values.filter("bucket_ts < 5")).count() == 0


def test_properties(spark):
    from tidemesh import views as V

    from tests.conftest import SF

    p = V.packets(spark, SF)
    r = summaries.cumulative_counts(p).first()
    assert r.rx_total == r.tx_total + r.drop_total == sum(r[f"type_{i}"] for i in range(16)) + r.type_other
    low, high = p.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1 and not math.isnan(high)
    assert series.rollup(p).filter("ds = 'rx_count'").agg(F.sum("average")).first()[0] == series.first_per_second(p).count()
    plan = reads.since(p, 24, V.NOW).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_live_summary_has_all_nodes(spark):
    from tidemesh import views as V

    n = 1500
    events = spark.range(2 * n + 1).select(
        F.col("id").alias("event_id"), F.expr("timestamp_seconds(1704067200 + id)").alias("ts"), F.when(F.col("id") < 2 * n, F.col("id") % n).alias("user_id"),
        F.when(F.col("id") < n, "view").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"),
    )
    noise = spark.createDataFrame([(1, 1.0, -99.5)], "id long, timestamp double, noise_floor_dbm double")
    live = lambda e, **more: summaries.live_stats(V.packets_of(e), V.adverts_of(e), noise, {}, V.NOW, V.NOW - 1, 0xAB, **more).first()
    assert len(live(events.filter("user_id IS NOT NULL")).neighbors) == n
    r = live(events)
    assert len(r.neighbors) == r.neighbor_count == n and {x.contact_type for x in r.neighbors.values()} == {"REPEATER"}
    assert {x.node_name for x in r.neighbors.values()} == {f"node-{i}" for i in range(n)}
    assert r.rx_count == r.duplicate_cache_size == 2 * n + 1 and r.noise_floor_dbm == -99.5
    assert {x.node_name for x in live(events, neighbours=3).neighbors.values()} == {f"node-{n - i}" for i in (1, 2, 3)}
    assert live(events.limit(0)).neighbors == {}
