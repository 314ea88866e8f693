"""What Spark makes of the queries: which conditions and columns reach the scan, and how many shuffles there are."""

import re

import pytest
from tidemesh import views as V
from tidemesh.operators import entities, reads, series, stateful, summaries

from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filters_reach_the_scan(spark):
    p, a = V.packets(spark, SF), V.advert_events(spark, SF)
    frames = {
        "since": reads.since(p, 24, V.NOW),
        "stats": summaries.packet_stats(p, 24, V.NOW),
        "fetched": series.fetched(p, V.NOW - 86400, V.NOW),
        "graph": series.metrics_graph(p, V.NOW - 86400, V.NOW),
        "retained": entities.retained(p, 7, V.NOW),
        "adverts": reads.adverts_by_contact_type(a, "REPEATER", 10, 24, V.NOW),
    }
    for name, df in frames.items():
        assert re.search(r"PushedFilters: \[[^]]*(GreaterThan|GreaterThanOrEqual)\(ts,", plan(df)), name


def test_scans_read_only_what_they_need(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(summaries.hourly_rates(V.packets(spark, SF), V.NOW))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "event_type"}


def test_samples_combine_before_the_shuffle(spark):
    text = plan(series.rollup(V.packets(spark, SF)))
    assert "partial_min" in text and "Window" not in text


def test_the_ring_is_found_by_one_aggregation(spark):
    text = plan(reads.recent_ring(V.packets(spark, SF)))
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("make", [lambda p: stateful.rolling_airtime(p), lambda p: summaries.running_counts(p)])
def test_windows_are_split_by_the_hour(spark, make):
    p = V.packets(spark, SF)
    parts = p.selectExpr("floor(ts_us / 3600000000) AS h").groupBy("h").count()
    assert parts.agg({"count": "max"}).first()[0] < 60
    assert re.search(r"Window .*part#", plan(make(p)))
