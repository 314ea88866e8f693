"""All telemetry queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh import views as V
from tidemesh.functions import codes, signal, text
from tidemesh.operators import calibration, decisions, entities, publish, reads, records, series, stateful, summaries
from tidemesh.sources import config, poller, tables
from tidemesh.streaming import ingest, messages

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
HOURS = 24
SINCE = V.NOW - HOURS * 3600
OWN = "AB"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {V.SQL}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_LIST = "array_to_string(original_path, ',')"


def _case(names: dict[int, str], column: str, other: str, last: int) -> str:
    return f"CASE WHEN {column} > {last} THEN '{other}' " + " ".join(f"WHEN {column} = {k} THEN '{v}'" for k, v in names.items()) + " END"


# Scans


@query("SELECT timestamp, type, route, length, rssi, snr, round(score, 12) AS score, transmitted, is_duplicate, drop_reason, src_hash, dst_hash, header, transport_codes, payload, payload_length, tx_delay_ms, packet_hash, " + _LIST + " AS original_path, raw_packet FROM packets")
def scan_packets(spark, sf):
    p = reads.scan_packets(V.packets(spark, sf))
    return p.drop("path_hash", "forwarded_path").withColumn("original_path", F.array_join("original_path", ",")).withColumn("score", F.round("score", 12))


@query(
    """, t AS (SELECT pubkey, min(id) AS id, max(timestamp) AS last_seen, min(timestamp) AS first_seen, CAST(count(*) AS INTEGER) AS advert_count,
        arg_max(struct_pack(ts := timestamp, n := node_name, r := is_repeater, rt := route_type, c := contact_type, la := latitude, lo := longitude, rs := rssi, s := snr, z := zero_hop), timestamp) AS l FROM advert_events GROUP BY pubkey)
    SELECT id, l.ts AS timestamp, pubkey, l.n AS node_name, l.r AS is_repeater, l.rt AS route_type, l.c AS contact_type, l.la AS latitude, l.lo AS longitude,
        first_seen, last_seen, l.rs AS rssi, l.s AS snr, advert_count, advert_count = 1 AS is_new_neighbor, l.z AS zero_hop FROM t"""
)
def scan_adverts(spark, sf):
    return reads.scan_adverts(entities.advert_upsert(V.advert_events(spark, sf)))


@query("SELECT timestamp, noise_floor_dbm FROM noise_floor")
def scan_noise_floor(spark, sf):
    return reads.scan(V.noise_floor(spark, sf), ["timestamp", "noise_floor_dbm"])


@query("SELECT * FROM transport_keys ORDER BY created_at, id")
def scan_transport_keys(spark, sf):
    return reads.scan_transport_keys(V.transport_keys(spark, sf))


@query("SELECT id, timestamp, upper(drop_reason) AS message, 'WARNING' AS level FROM packets WHERE drop_reason IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 100")
def log_buffer(spark, sf):
    p = V.packets(spark, sf).filter(F.col("drop_reason").isNotNull())
    return reads.log_ring(p.select("id", "timestamp", F.upper("drop_reason").alias("message"), F.lit("WARNING").alias("level")))


@query("SELECT CAST(i AS INTEGER) AS position, n AS name FROM (SELECT unnest(range(0, 8)) AS i, unnest(['id', 'name', 'flood_policy', 'transport_key', 'last_used', 'parent_id', 'created_at', 'updated_at']) AS n)")
def table_columns(spark, sf):
    return tables.columns_of(V.transport_keys(spark, sf))


@query("SELECT id, type, false AS local FROM packets WHERE type <> 4 UNION ALL SELECT id, type, true FROM packets WHERE type = 4")
def local_injection(spark, sf):
    p = V.packets(spark, sf).select("id", "type")
    return ingest.with_local(p.filter("type <> 4"), p.filter("type = 4"))


# Filters, orders, limits


@query(f"SELECT id, type FROM packets WHERE timestamp > {SINCE}")
def recent_window(spark, sf):
    return reads.since(V.packets(spark, sf), HOURS, V.NOW).select("id", "type")


@query(f"SELECT id, timestamp, type, route FROM packets WHERE type = 4 AND route = 2 AND timestamp >= {V.NOW - 20 * 86400} AND timestamp <= {V.NOW} ORDER BY timestamp DESC, id DESC LIMIT 1000")
def filtered_packets(spark, sf):
    return reads.filtered_packets(V.packets(spark, sf), 4, 2, V.NOW - 20 * 86400, V.NOW).select("id", "timestamp", "type", "route")


@query("SELECT id, timestamp, packet_hash FROM packets WHERE packet_hash = upper(substr(md5('7'), 1, 16)) ORDER BY timestamp, id LIMIT 1")
def packet_by_hash(spark, sf):
    import hashlib

    return reads.packet_by_hash(V.packets(spark, sf), hashlib.md5(b"7").hexdigest().upper()[:16]).select("id", "timestamp", "packet_hash")


@query("SELECT * FROM transport_keys WHERE id = 3")
def transport_key_by_id(spark, sf):
    return reads.by_id(V.transport_keys(spark, sf), 3)


@query("SELECT id, drop_reason FROM packets WHERE NOT transmitted AND drop_reason IS NOT NULL")
def dropped_with_reason(spark, sf):
    return reads.dropped_with_reason(V.packets(spark, sf)).select("id", "drop_reason")


@query(f"SELECT id, timestamp, pubkey, contact_type FROM advert_events WHERE contact_type = 'REPEATER' AND timestamp > {V.NOW - 100 * 3600} ORDER BY timestamp DESC, id DESC LIMIT 50")
def adverts_by_contact_type(spark, sf):
    return reads.adverts_by_contact_type(V.advert_events(spark, sf), "REPEATER", 50, 100, V.NOW).select("id", "timestamp", "pubkey", "contact_type")


@query("SELECT id, (length & (1 << (type % 8))) <> 0 AS answers FROM packets")
def discovery_filter(spark, sf):
    p = V.packets(spark, sf)
    return p.select("id", reads.answers_discovery((F.col("type") % 8).cast("int"), F.col("length")).alias("answers"))


@query("SELECT id, node_name FROM advert_events WHERE is_repeater AND pubkey <> md5('1') AND route_type IN (2, 3)")
def zero_hop_repeaters(spark, sf):
    import hashlib

    a = V.advert_events(spark, sf)
    return a.filter(F.upper("contact_type").contains("REPEATER") & text.zero_hop(F.col("route_type")) & (F.col("pubkey") != hashlib.md5(b"1").hexdigest())).select("id", "node_name")


@query("SELECT id, coalesce(payload <> '' AND coalesce(len(original_path), 0) < 8, false) AS valid FROM packets")
def valid_packets(spark, sf):
    return V.packets(spark, sf).select("id", reads.valid_packet(F.col("payload"), F.col("original_path"), 8).alias("valid"))


@query("SELECT id, timestamp, type, rssi FROM packets ORDER BY timestamp DESC, id DESC LIMIT 100")
def recent_packets(spark, sf):
    return reads.newest(V.packets(spark, sf), 100).select("id", "timestamp", "type", "rssi")


@query("SELECT id, rssi AS cpu_percent FROM packets ORDER BY rssi DESC, id LIMIT 10")
def top_processes(spark, sf):
    return reads.top_by(V.packets(spark, sf).select("id", F.col("rssi").alias("cpu_percent")), "cpu_percent", 10)


@query("SELECT id, length % 4 < len(original_path) AND original_path[1 + length % 4] = 'AB' AND NOT is_duplicate AS forwards FROM packets WHERE type = 9 AND original_path IS NOT NULL")
def trace_forward(spark, sf):
    p = V.packets(spark, sf).filter("type = 9 AND original_path IS NOT NULL")
    return p.select("id", F.coalesce(reads.forwards_trace(F.col("length") % 4, F.col("original_path"), OWN, F.col("is_duplicate")), F.lit(False)).alias("forwards"))


@query(
    """SELECT id, CASE WHEN length % 4 >= route THEN 'Trace completed' WHEN len(original_path) <= length % 4 THEN 'Path index out of bounds'
        WHEN original_path[1 + length % 4] <> 'AB' THEN 'Not our turn' WHEN is_duplicate THEN 'Duplicate packet' END AS reason FROM packets WHERE original_path IS NOT NULL"""
)
def no_forward_reason(spark, sf):
    p = V.packets(spark, sf).filter("original_path IS NOT NULL")
    return p.select("id", reads.no_forward_reason(F.col("length") % 4, F.col("original_path"), F.col("route"), OWN, F.col("is_duplicate")).alias("reason"))


# Summaries


@query(
    f"""SELECT count(*) AS total_packets, CAST(sum(CAST(transmitted AS INT)) AS BIGINT) AS transmitted_packets, CAST(sum(1 - CAST(transmitted AS INT)) AS BIGINT) AS dropped_packets,
        round(coalesce(avg(rssi), 0), 1) AS avg_rssi, round(coalesce(avg(snr), 0), 1) AS avg_snr, round(coalesce(avg(score), 0), 3) AS avg_score,
        round(coalesce(avg(payload_length), 0), 1) AS avg_payload_length, round(coalesce(avg(tx_delay_ms), 0), 1) AS avg_tx_delay FROM packets WHERE timestamp > {SINCE}"""
)
def packet_stats(spark, sf):
    return summaries.packet_stats(V.packets(spark, sf), HOURS, V.NOW)


@query(f"SELECT type, count(*) AS count FROM packets WHERE timestamp > {SINCE} GROUP BY type")
def packet_type_histogram(spark, sf):
    return summaries.histogram(V.packets(spark, sf), "type", HOURS, V.NOW)


@query(f"SELECT drop_reason, count(*) AS count FROM packets WHERE timestamp > {SINCE} AND NOT transmitted AND drop_reason IS NOT NULL GROUP BY drop_reason")
def drop_reason_histogram(spark, sf):
    return summaries.drop_reasons(V.packets(spark, sf), HOURS, V.NOW)


_TYPES = f"SELECT least(type, 16) AS code, {_case(codes.TYPE_NAMES, 'least(type, 16)', codes.OTHER_TYPES, 15)} AS name, count(*) AS count FROM packets WHERE timestamp > {SINCE} AND type >= 0 GROUP BY ALL"


@query(_TYPES)
def packet_type_stats(spark, sf):
    return summaries.type_stats(V.packets(spark, sf), HOURS, V.NOW)


@query(f"SELECT name, replace(replace(replace(lower(name), ' ', '_'), '(', ''), ')', '') AS type, {V.NOW * 1000} AS end_ms, count FROM ({_TYPES})")
def packet_type_graph(spark, sf):
    return summaries.type_graph(V.packets(spark, sf), HOURS, V.NOW)


@query(f"SELECT least(route, 4) AS code, {_case(codes.ROUTE_NAMES, 'least(route, 4)', codes.OTHER_ROUTES, 3)} AS name, count(*) AS count FROM packets WHERE timestamp > {SINCE} AND route >= 0 GROUP BY ALL")
def route_stats(spark, sf):
    return summaries.route_stats(V.packets(spark, sf), HOURS, V.NOW)


@query("SELECT count(*) AS rx_total, count(*) FILTER (transmitted) AS tx_total, count(*) FILTER (NOT transmitted) AS drop_total, " + ", ".join(f"count(*) FILTER (type = {i}) AS type_{i}" for i in range(16)) + ", count(*) FILTER (type > 15) AS type_other FROM packets")
def cumulative_counts(spark, sf):
    return summaries.cumulative_counts(V.packets(spark, sf))


@query(
    """SELECT id, timestamp, count(*) OVER w AS rx_total, CAST(sum(CAST(transmitted AS INT)) OVER w AS BIGINT) AS tx_total, CAST(sum(1 - CAST(transmitted AS INT)) OVER w AS BIGINT) AS dropped_total
    FROM packets WINDOW w AS (ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)"""
)
def running_counts(spark, sf):
    return summaries.running_counts(V.packets(spark, sf))


@query(f"SELECT count(*) AS measurement_count, round(coalesce(avg(noise_floor_dbm), 0), 1) AS avg_noise_floor, round(coalesce(min(noise_floor_dbm), 0), 1) AS min_noise_floor, round(coalesce(max(noise_floor_dbm), 0), 1) AS max_noise_floor FROM noise_floor WHERE timestamp > {SINCE}")
def noise_floor_stats(spark, sf):
    return summaries.noise_stats(V.noise_floor(spark, sf), HOURS, V.NOW)


@query(f"SELECT id, timestamp, noise_floor_dbm FROM noise_floor WHERE timestamp > {SINCE} ORDER BY timestamp, id")
def noise_floor_history(spark, sf):
    return summaries.noise_history(V.noise_floor(spark, sf), HOURS, V.NOW)


@query(f"SELECT count(*) AS rx_per_hour, count(*) FILTER (transmitted) AS forwarded_per_hour FROM packets WHERE timestamp > {V.NOW - 3600}")
def hourly_rates(spark, sf):
    return summaries.hourly_rates(V.packets(spark, sf), V.NOW)


_AIR = f"coalesce(sum(airtime_ms) FILTER (timestamp > {V.NOW - 3600} AND timestamp <= {V.NOW}), 0)"


@query(f"SELECT round({_AIR}, 3) AS current_airtime_ms, round(100.0 * {_AIR} / 3600, 3) AS utilization_percent, round(coalesce(sum(airtime_ms), 0), 3) AS total_airtime_ms FROM packets WHERE transmitted")
def airtime_use(spark, sf):
    return summaries.airtime_use(V.packets(spark, sf), V.NOW, 3600.0)


@query(
    f"""SELECT count(*) AS rx_count, count(*) FILTER (transmitted) AS forwarded_count, count(*) FILTER (NOT transmitted) AS dropped_count,
        count(*) FILTER (timestamp > {V.NOW - 3600}) AS rx_per_hour, count(*) FILTER (transmitted AND timestamp > {V.NOW - 3600}) AS forwarded_per_hour,
        round(coalesce(sum(airtime_ms) FILTER (transmitted AND timestamp > {V.NOW - 60} AND timestamp <= {V.NOW}), 0), 3) AS current_airtime_ms,
        round(100.0 * coalesce(sum(airtime_ms) FILTER (transmitted AND timestamp > {V.NOW - 60} AND timestamp <= {V.NOW}), 0) / 3600, 3) AS utilization_percent,
        round(coalesce(sum(airtime_ms) FILTER (transmitted), 0), 3) AS total_airtime_ms, (SELECT count(DISTINCT pubkey) FROM advert_events) AS neighbor_count FROM packets"""
)
def node_stats(spark, sf):
    return summaries.node_stats(V.packets(spark, sf), V.advert_events(spark, sf), V.NOW)


# Scalar functions


@query("SELECT id, round(score, 12) AS score FROM packets")
def packet_score(spark, sf):
    p = V.packets(spark, sf)
    return p.select("id", F.round(signal.packet_score(F.col("snr"), F.col("length")), 12).alias("score"))


@query("SELECT id, round(airtime_ms, 6) AS airtime_ms FROM packets")
def airtime_estimate(spark, sf):
    return V.packets(spark, sf).select("id", F.round(signal.airtime_ms(F.col("length"), 8, 62_500), 6).alias("airtime_ms"))


@query(
    """, d AS (SELECT id, CASE WHEN route = 1 THEN airtime_ms * 52 / 50 / 2 * (id % 50 / 10.0) / 1000 ELSE 0.5 END AS s, score FROM packets)
    SELECT id, round(least(5.0, CASE WHEN s >= 0.05 THEN s * greatest(0.2, 1 - score) ELSE s END), 12) AS delay_s FROM d"""
)
def tx_delay(spark, sf):
    delay = signal.tx_delay_s(F.col("route"), F.col("airtime_ms"), F.col("id") % 50 / 10.0, F.col("score"), damp=True)
    return V.packets(spark, sf).select("id", F.round(delay, 12).alias("delay_s"))


@query("SELECT id, CAST((greatest(-128, least(127, CAST(trunc(snr * 4) AS INTEGER))) + 256) % 256 AS INTEGER) AS snr_byte, snr AS decoded FROM packets")
def snr_bytes(spark, sf):
    p = V.packets(spark, sf).select("id", signal.snr_byte(F.col("snr")).alias("snr_byte"))
    return p.withColumn("decoded", signal.snr_from_byte(F.col("snr_byte")))


@query(
    """SELECT id, header, type % 16 AS payload_type, CASE WHEN len(original_path) > 8 THEN '[' || array_to_string(original_path[1:8], ', ') || ', ...]' WHEN len(original_path) > 0 THEN '[' || array_to_string(original_path, ', ') || ']' END AS path_hash,
        CASE WHEN type IN (0, 1, 2, 8) THEN upper(substr(payload, 3, 2)) WHEN type = 4 THEN upper(substr(payload, 1, 2)) END AS src, CASE WHEN type IN (0, 1, 2, 8) THEN upper(substr(payload, 1, 2)) END AS dst,
        packet_hash, length(raw_packet) // 2 AS raw_bytes FROM packets"""
)
def packet_fields(spark, sf):
    p = V.packets(spark, sf)
    number = F.conv(F.substring("header", 3, 2), 16, 10).cast("int")
    return p.select(
        "id", text.header_text(number).alias("header"), text.payload_type(number).alias("payload_type"), text.path_text(F.col("original_path")).alias("path_hash"), text.source_hash(F.col("type"), F.col("payload")).alias("src"),
        text.destination_hash(F.col("type"), F.col("payload")).alias("dst"), text.hash_prefix(F.lower("packet_hash")).alias("packet_hash"), text.hex_bytes(F.col("raw_packet")).cast("long").alias("raw_bytes"),
    )


@query("SELECT id, substr(transport_key, 1, 8) || '...' || substr(transport_key, 25, 8) AS short_key, replace(replace(replace(base64(encode(name)), '+', '-'), '/', '_'), '=', '') AS url_key FROM transport_keys")
def key_texts(spark, sf):
    k = V.transport_keys(spark, sf)
    return k.select("id", text.shortened_key(F.col("transport_key")).alias("short_key"), text.base64url(F.encode("name", "UTF-8")).alias("url_key"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE epoch(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(id AS INTEGER))) END AS parsed FROM packets")
def iso_parse(spark, sf):
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.when(F.col("id") % 3 == 0, "no time").otherwise(at)
    return V.packets(spark, sf).select("id", F.unix_timestamp(text.parsed_time(given)).cast("double").alias("parsed"))


# Records


@query(
    """SELECT 'node' AS origin, 'KEY' AS origin_id, CASE WHEN ts_us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, 'PACKET' AS type, 'rx' AS direction,
        strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%-d/%-m/%Y') AS date, CAST(length(raw_packet) // 2 AS VARCHAR) AS len, CAST(type AS VARCHAR) AS packet_type,
        CASE route WHEN 1 THEN 'F' WHEN 2 THEN 'D' ELSE CAST(route AS VARCHAR) END AS route, CAST(payload_length AS VARCHAR) AS payload_len, raw_packet AS raw, CAST(CAST(snr AS DOUBLE) AS VARCHAR) AS "SNR", CAST(rssi AS VARCHAR) AS "RSSI",
        CAST(CAST(trunc(score * 1000) AS INTEGER) AS VARCHAR) AS score, '0' AS duration, packet_hash AS hash FROM packets"""
)
def publish_projection(spark, sf):
    return publish.published(V.packets(spark, sf), "node", "KEY")


@query("SELECT id, type FROM packets WHERE coalesce(drop_reason, '') NOT IN ('Invalid advert packet', 'Empty payload', 'Path too long') AND type NOT IN (4, 9) AND raw_packet <> ''")
def publish_admission(spark, sf):
    disallowed = publish.disallowed_types(spark, ["advert", "TRACE", "nonsense"])
    return publish.admitted(V.packets(spark, sf), disallowed).select("id", "type")


@query("""SELECT id, '{"type":' || type || CASE WHEN drop_reason IS NULL THEN '' ELSE ',"drop_reason":"' || drop_reason || '"' END || ',"rssi":' || rssi || '}' AS payload FROM packets""")
def publish_json(spark, sf):
    return publish.as_json(V.packets(spark, sf).select("id", "type", "drop_reason", "rssi"))


@query("""SELECT timestamp, type, route, length, CAST(transmitted AS INTEGER) AS transmitted, CAST(is_duplicate AS INTEGER) AS is_duplicate, drop_reason, CASE WHEN original_path IS NOT NULL THEN '["' || array_to_string(original_path, '","') || '"]' END AS original_path, packet_hash FROM packets""")
def store_packet(spark, sf):
    return publish.stored_form(V.packets(spark, sf), V.NOW)


_DROP = f"""CASE WHEN route IN (0, 1) AND payload = '' THEN 'Empty payload'
    WHEN route IN (0, 1) AND coalesce(len(original_path), 0) >= 9 THEN 'Path length ' || len(original_path) || ' exceeds MAX_PATH_SIZE (9)'
    WHEN route IN (0, 1) AND type = 11 THEN 'Marked do not retransmit' WHEN route IN (0, 1) AND is_duplicate THEN 'Duplicate'
    WHEN route IN (2, 3) AND coalesce(len(original_path), 0) = 0 THEN 'Direct: no path' WHEN route IN (2, 3) AND original_path[1] <> '{OWN}' THEN 'Direct: not for us'
    WHEN route NOT IN (0, 1, 2, 3) THEN 'Unknown route type: ' || route WHEN length > 190 THEN 'Duty cycle limit' END"""


@query(f"SELECT id, {_DROP} AS reason, CASE WHEN type = 9 THEN 'trace' WHEN type = 11 THEN 'control' WHEN type = 4 THEN 'advert' ELSE 'repeater' END AS handler FROM packets")
def drop_decision(spark, sf):
    p = V.packets(spark, sf)
    preset = F.when(F.col("type") == 11, "Marked do not retransmit")
    reason = decisions.drop_reason(OWN, 9, preset=preset, seen=F.col("is_duplicate"), over_budget=F.col("length") > 190)
    return p.select("id", reason.alias("reason"), decisions.handler(F.col("type")).alias("handler"))


@query(f"SELECT id, CASE WHEN route IN (0, 1) THEN array_to_string(list_append(coalesce(original_path, []), '{OWN}'), ',') WHEN route IN (2, 3) THEN coalesce(array_to_string(original_path[2:], ','), '') END AS forwarded FROM packets")
def forwarded_paths(spark, sf):
    return V.packets(spark, sf).select("id", F.array_join(decisions.forwarded_path(OWN), ",").alias("forwarded"))


@query("SELECT id, CAST(i - 1 AS INTEGER) AS pos, original_path[i] AS hop, CAST(snr + i - 1 AS DOUBLE) AS snr FROM (SELECT id, original_path, snr, unnest(range(1, least(len(original_path), 5) + 1)) AS i FROM packets WHERE type = 9 AND original_path IS NOT NULL)")
def path_snr_zip(spark, sf):
    p = V.packets(spark, sf).filter("type = 9 AND original_path IS NOT NULL")
    values = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("snr") + i)
    zipped = p.withColumn("values", values).select("id", F.posexplode(entities.paired(F.col("original_path"), F.col("values"))).alias("pos", "e"))
    return zipped.select("id", "pos", F.col("e.hop").alias("hop"), F.col("e.value").alias("snr"))


# Nodes, copies, keys


@query("SELECT pubkey, id, timestamp, node_name, contact_type, route_type, latitude, longitude, rssi, CAST(snr AS DOUBLE) AS snr, zero_hop FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY timestamp DESC, id DESC) AS r FROM advert_events) WHERE r = 1")
def neighbors_latest(spark, sf):
    return entities.neighbors_latest(V.advert_events(spark, sf)).select("pubkey", "id", "timestamp", "node_name", "contact_type", "route_type", "latitude", "longitude", "rssi", "snr", "zero_hop")


@query("SELECT pubkey, min(id) AS id, arg_max(contact_type, timestamp) AS contact_type, arg_max(node_name, timestamp) AS node_name, arg_max(is_repeater, timestamp) AS is_repeater, arg_max(route_type, timestamp) AS route_type, arg_max(latitude, timestamp) AS latitude, arg_max(longitude, timestamp) AS longitude, arg_max(rssi, timestamp) AS rssi, CAST(arg_max(snr, timestamp) AS DOUBLE) AS snr, arg_max(zero_hop, timestamp) AS zero_hop, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(count(*) AS INTEGER) AS advert_count, count(*) = 1 AS is_new_neighbor FROM advert_events GROUP BY pubkey")
def advert_upsert(spark, sf):
    return entities.advert_upsert(V.advert_events(spark, sf)).select("pubkey", "id", "contact_type", "node_name", "is_repeater", "route_type", "latitude", "longitude", "rssi", "snr", "zero_hop", "first_seen", "last_seen", "advert_count", "is_new_neighbor")


@query("SELECT pubkey, min(id) AS id, arg_max(contact_type, timestamp) AS contact_type, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(count(*) AS INTEGER) AS advert_count FROM advert_events GROUP BY pubkey")
def advert_merge(spark, sf):
    a = V.advert_events(spark, sf)
    return entities.merged(entities.advert_upsert(a.filter("id % 2 = 0")), a.filter("id % 2 = 1")).select("pubkey", "id", "contact_type", "first_seen", "last_seen", "advert_count")


@query("SELECT pubkey, arg_min(id, timestamp) AS id, min(timestamp) AS timestamp FROM advert_events WHERE pubkey NOT IN (SELECT pubkey FROM advert_events WHERE id < 50) GROUP BY pubkey")
def first_seen_neighbor(spark, sf):
    a = V.advert_events(spark, sf)
    return entities.first_seen_neighbors(a, a.filter("id < 50")).select("pubkey", "id", "timestamp")


@query("SELECT id, packet_hash FROM packets WHERE packet_hash IN (SELECT packet_hash FROM packets WHERE id < 100)")
def dedup_probe(spark, sf):
    p = V.packets(spark, sf)
    return entities.already_seen(p, p.filter("id < 100")).select("id", "packet_hash")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY packet_hash ORDER BY timestamp, id) AS n FROM packets)
    SELECT f.id, f.packet_hash, CAST((SELECT count(*) FROM r d WHERE d.packet_hash = f.packet_hash AND d.n > 1) AS INTEGER) AS duplicate_count,
        (SELECT string_agg(d.id, ',' ORDER BY d.timestamp, d.id) FROM r d WHERE d.packet_hash = f.packet_hash AND d.n > 1) AS duplicate_ids FROM r f WHERE f.n = 1"""
)
def duplicates_nested(spark, sf):
    d = entities.duplicates_nested(V.packets(spark, sf))
    return d.select("id", "packet_hash", "duplicate_count", F.when(F.col("duplicates").isNotNull(), F.array_join(F.transform("duplicates", lambda x: x["id"].cast("string")), ",")).alias("duplicate_ids"))


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY packet_hash ORDER BY timestamp, id) AS n, count(*) OVER (PARTITION BY packet_hash) AS c FROM packets)
    SELECT id, timestamp, packet_hash, CAST(c - 1 AS INTEGER) AS duplicate_count FROM r WHERE n = 1 ORDER BY timestamp DESC, id DESC LIMIT 50"""
)
def recent_ring(spark, sf):
    return reads.recent_ring(V.packets(spark, sf)).select("id", "timestamp", "packet_hash", "duplicate_count")


def _coded(spark, sf):
    return V.packets(spark, sf).withColumn("transport_code", F.when(F.col("type") % 2 == 0, (F.col("id") % 40).cast("string")))


_MATCH = """, m AS (SELECT p.id, p.timestamp, CAST(p.id % 40 AS VARCHAR) AS transport_code, k.name, k.flood_policy, row_number() OVER (PARTITION BY p.id ORDER BY k.created_at, k.id) AS r
    FROM packets p LEFT JOIN transport_keys k ON CAST(p.id % 40 AS VARCHAR) = CAST(k.id % 40 AS VARCHAR) WHERE p.type % 2 = 0) """


@query(_MATCH + "SELECT id, transport_code, name AS key_name, coalesce(flood_policy, 'none') AS verdict FROM m WHERE r = 1")
def transport_key_match(spark, sf):
    return entities.match_transport_key(_coded(spark, sf), V.transport_keys(spark, sf), (F.col("key_id") % 40).cast("string"))


@query(_MATCH + "SELECT name AS key_name, max(timestamp) AS last_used FROM m WHERE r = 1 AND name IS NOT NULL GROUP BY name")
def transport_key_last_use(spark, sf):
    p = _coded(spark, sf)
    return entities.last_use(entities.match_transport_key(p, V.transport_keys(spark, sf), (F.col("key_id") % 40).cast("string")), p)


@query(
    f"""SELECT id, CASE WHEN id = 2 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 4 THEN 'allow' ELSE flood_policy END AS flood_policy, CASE WHEN id IN (2, 4) THEN {float(V.NOW)} ELSE updated_at END AS updated_at FROM transport_keys WHERE id <> 5
    UNION ALL SELECT 900, 'new', 'deny', {float(V.NOW)}"""
)
def transport_key_crud(spark, sf):
    keys = V.transport_keys(spark, sf)
    changes = spark.createDataFrame([(2, "renamed", None), (4, None, "allow")], "id long, name string, flood_policy string")
    new = spark.createDataFrame([(900, "new", "deny", "a2V5", None, None, float(V.NOW), float(V.NOW))], keys.schema)
    keys = entities.inserted(entities.updated(keys, changes, V.NOW), new)
    return entities.deleted(keys, spark.createDataFrame([(5,)], "id long")).select("id", "name", "flood_policy", "updated_at")


@query("SELECT name, 'name used twice' AS problem FROM transport_keys UNION ALL SELECT name, 'name used twice' FROM transport_keys")
def transport_key_checks(spark, sf):
    keys = V.transport_keys(spark, sf)
    return entities.key_violations(keys.union(keys)).select("name", "problem")


@query()
def key_tree(spark, sf):
    return entities.key_tree(V.transport_keys(spark, sf))


_SQL["key_tree"] = f"WITH RECURSIVE {V.SQL}, tree AS (SELECT id, name, 0 AS depth, name AS path FROM transport_keys WHERE parent_id IS NULL UNION ALL SELECT k.id, k.name, t.depth + 1, t.path || '/' || k.name FROM transport_keys k JOIN tree t ON k.parent_id = t.id) SELECT * FROM tree"


@query("SELECT id FROM advert_events WHERE id <> 7")
def delete_advert(spark, sf):
    return entities.deleted(V.advert_events(spark, sf), spark.createDataFrame([(7,)], "id long")).select("id")


_OLD = V.NOW - 7 * 86400
_CLEANED = {"packets": "packets", "adverts": "(SELECT pubkey, max(timestamp) AS timestamp FROM advert_events GROUP BY pubkey)", "noise_floor": "noise_floor"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) FILTER (timestamp >= {_OLD}) AS kept, count(*) FILTER (timestamp < {_OLD}) AS removed FROM {t}" for n, t in _CLEANED.items()))
def cleanup_old_data(spark, sf):
    out = None
    for name, table in (("packets", V.packets(spark, sf)), ("adverts", entities.advert_upsert(V.advert_events(spark, sf))), ("noise_floor", V.noise_floor(spark, sf))):
        total, kept = table.agg(F.count(F.lit(1)).alias("total")), entities.retained(table, 7, V.NOW).agg(F.count(F.lit(1)).alias("kept"))
        row = total.join(F.broadcast(kept)).select(F.lit(name).alias("table_name"), "kept", (F.col("total") - F.col("kept")).alias("removed"))
        out = row if out is None else out.union(row)
    return out


@query("SELECT id, pubkey, false AS zero_hop FROM advert_events")
def schema_migration(spark, sf):
    old = V.advert_events(spark, sf).select("id", "pubkey")
    return entities.with_column(entities.with_column(old, "zero_hop", F.lit(False)), "zero_hop", F.lit(True))


# Calibration


@query(", g AS (SELECT CAST(p AS INTEGER) AS det_peak, CAST(m AS INTEGER) AS det_min, sqrt(pow(p - 25.5, 2) + pow(m - 15.5, 2)) AS distance FROM range(22, 30) a(p), range(12, 20) b(m)) SELECT det_peak, det_min, round(distance, 9) AS distance, CAST(row_number() OVER (ORDER BY distance, det_peak, det_min) AS INTEGER) AS place FROM g")
def cad_center_out(spark, sf):
    return calibration.centre_out(calibration.grid(spark)).withColumn("distance", F.round("distance", 9))


@query(
    """, g AS (SELECT CAST(p AS INTEGER) AS det_peak, CAST(m AS INTEGER) AS det_min, sqrt(pow(p - 25.5, 2) + pow(m - 15.5, 2)) AS distance FROM range(22, 30) a(p), range(12, 20) b(m))
    SELECT det_peak, det_min, CAST((row_number() OVER (ORDER BY distance, det_peak, det_min) - 1) // 8 AS INTEGER) AS band FROM g"""
)
def cad_bands(spark, sf):
    return calibration.banded(calibration.grid(spark)).select("det_peak", "det_min", "band")


_RATES = """, s AS (SELECT CAST(22 + type % 8 AS INTEGER) AS det_peak, CAST(12 + length % 8 AS INTEGER) AS det_min, transmitted AS detected, id % 5 = 0 AS baseline FROM packets),
r AS (SELECT det_peak, det_min, count(*) AS samples, count(*) FILTER (detected) AS detections, avg(CAST(detected AS DOUBLE)) * 100 AS detection_rate, avg(CAST(baseline AS DOUBLE)) * 100 AS baseline_rate FROM s GROUP BY ALL),
a AS (SELECT *, greatest(0.0, detection_rate - baseline_rate) AS adjusted_rate FROM r),
q AS (SELECT *, greatest(0.0, 100.0 - abs(adjusted_rate - 20.0) / 20.0 * 50.0 - (abs(det_peak - 25) + abs(det_min - 15)) / 20.0 * 20.0) AS sensitivity_score FROM a) """


def _rated(spark, sf):
    samples = V.packets(spark, sf).select((22 + F.col("type") % 8).alias("det_peak"), (12 + F.col("length") % 8).alias("det_min"), F.col("transmitted").alias("detected"), (F.col("id") % 5 == 0).alias("baseline"))
    return summaries.detection_rates(samples).withColumn("sensitivity_score", signal.sensitivity(F.col("det_peak"), F.col("det_min"), F.col("adjusted_rate")))


@query(_RATES + "SELECT det_peak, det_min, samples, detections, round(detection_rate, 6) AS detection_rate, round(adjusted_rate, 6) AS adjusted_rate, round(sensitivity_score, 6) AS sensitivity_score FROM q")
def cad_sensitivity(spark, sf):
    r = _rated(spark, sf)
    return r.select("det_peak", "det_min", "samples", "detections", *(F.round(c, 6).alias(c) for c in ("detection_rate", "adjusted_rate", "sensitivity_score")))


@query(_RATES + ", i AS (SELECT count(*) FILTER (adjusted_rate BETWEEN 10 AND 30) AS n FROM q) SELECT det_peak, det_min, round(sensitivity_score, 6) AS sensitivity_score, n AS ideal_cells FROM q, i WHERE n = 0 OR adjusted_rate BETWEEN 10 AND 30 ORDER BY q.sensitivity_score DESC, det_peak, det_min LIMIT 1")
def cad_best(spark, sf):
    return calibration.best(_rated(spark, sf)).select("det_peak", "det_min", F.round("sensitivity_score", 6).alias("sensitivity_score"), "ideal_cells")


# Time series

_FED = """, fed AS (SELECT *, ts_us // 1000000 AS second FROM (SELECT *, row_number() OVER (PARTITION BY ts_us // 1000000 ORDER BY ts_us, id) AS r FROM packets) WHERE r = 1)"""


def _rolled(step: int) -> str:
    gauges = [(n, f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN CAST({c} AS DOUBLE) END") for n, (c, lo, hi) in codes.GAUGES.items()]
    ones = [("rx_count", "1.0"), ("tx_count", "CAST(transmitted AS INT)"), ("drop_count", "1 - CAST(transmitted AS INT)"), *((f"type_{i}", f"CAST(type = {i} AS INT)") for i in range(16)), ("type_other", "CAST(type > 15 AS INT)")]
    b = f"second // {step} * {step} AS bucket_ts"
    parts = [f"SELECT {b}, '{n}' AS ds, count({e}) AS samples, avg({e}) AS average, min({e}) AS least, max({e}) AS most FROM fed GROUP BY 1" for n, e in gauges]
    parts += [f"SELECT {b}, '{n}', count(*), CAST(sum({e}) AS DOUBLE), CAST(sum({e}) AS DOUBLE), CAST(sum({e}) AS DOUBLE) FROM fed GROUP BY 1" for n, e in ones]
    return f"{_FED}, rolled AS ({' UNION ALL '.join(parts)}) "


def _steady(column: str):
    """A mean to six digits. It is cut to twelve first, as a sum's last bits depend on the order of its terms, and would else decide ties."""
    return F.round(F.round(column, 12), 6)


@query(_rolled(60) + "SELECT bucket_ts, ds, samples, round(average, 12) AS average, round(least, 12) AS least, round(most, 12) AS most FROM rolled")
def rollup_60s(spark, sf):
    return series.rollup(V.packets(spark, sf)).select("bucket_ts", "ds", "samples", *(F.round(c, 12).alias(c) for c in ("average", "least", "most")))


@query(_rolled(3600) + "SELECT bucket_ts, ds, samples, round(average, 6) AS average FROM rolled")
def rollup_3600s(spark, sf):
    return series.rollup(V.packets(spark, sf), 3600).select("bucket_ts", "ds", "samples", _steady("average").alias("average"))


_XFF = _rolled(60) + ", c AS (SELECT bucket_ts // 300 * 300 AS bucket_ts, ds, count(CASE WHEN samples > 0 THEN average END) AS known, avg(average) AS mean FROM rolled GROUP BY 1, 2) "


@query(_XFF + "SELECT bucket_ts, ds, known, CASE WHEN known >= 2.5 THEN round(mean, 6) END AS value FROM c")
def rollup_xff_300s(spark, sf):
    return series.consolidated(series.rollup(V.packets(spark, sf))).withColumn("value", _steady("value"))


_DAY = f"fed_day AS (SELECT * FROM fed WHERE second >= {SINCE} AND second < {V.NOW})"
_GRID = f"grid AS (SELECT b AS bucket_ts, ds FROM range({SINCE}, {V.NOW}, 60) t(b), (VALUES ('rx_count'), ('avg_snr')) d(ds))"
_POINTS = (
    _FED
    + f", {_DAY}, {_GRID}, pts AS (SELECT second // 60 * 60 AS bucket_ts, 'rx_count' AS ds, CAST(count(*) AS DOUBLE) AS value FROM fed_day GROUP BY 1 UNION ALL SELECT second // 60 * 60, 'avg_snr', avg(CASE WHEN snr BETWEEN -30 AND 30 THEN snr END) FROM fed_day GROUP BY 1), filled AS (SELECT bucket_ts, ds, value FROM grid LEFT JOIN pts USING (bucket_ts, ds)) "
)


def _filled(spark, sf) -> DataFrame:
    return series.gap_filled(series.fetched(V.packets(spark, sf), SINCE, V.NOW), SINCE, V.NOW, 60, ["rx_count", "avg_snr"])


@query(_POINTS + "SELECT bucket_ts, ds, round(value, 12) AS value FROM filled")
def gap_fill(spark, sf):
    return _filled(spark, sf).withColumn("value", F.round("value", 12))


_DELTA = _POINTS + ", deltas AS (SELECT bucket_ts, ds, value, CASE WHEN value IS NULL OR lag(value) OVER w IS NULL THEN 0.0 ELSE greatest(0.0, value - lag(value) OVER w) END AS delta FROM filled WINDOW w AS (PARTITION BY ds ORDER BY bucket_ts)) "


@query(_DELTA + "SELECT bucket_ts, ds, round(value, 12) AS value, round(delta, 12) AS delta FROM deltas")
def counter_delta(spark, sf):
    return series.counter_delta(_filled(spark, sf)).select("bucket_ts", "ds", F.round("value", 12).alias("value"), F.round("delta", 12).alias("delta"))


@query(_POINTS + "SELECT bucket_ts, ds, coalesce(round(value, 12), 0) AS value FROM filled WHERE ds = 'avg_snr'")
def gauge_fill(spark, sf):
    return series.gauge_filled(_filled(spark, sf).filter("ds = 'avg_snr'")).withColumn("value", F.round("value", 12))


@query(f", c AS (SELECT ts_us / 1000000.0 AS ts, CAST(count(*) OVER (ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM packets) SELECT ts, round(CASE WHEN ts - lag(ts) OVER w > 0 AND ts - lag(ts) OVER w <= {series.HEARTBEAT} THEN (value - lag(value) OVER w) / (ts - lag(ts) OVER w) END, 6) AS rate FROM c WINDOW w AS (ORDER BY ts)")
def counter_rate(spark, sf):
    totals = summaries.running_counts(V.packets(spark, sf)).select(F.lit("rx_count").alias("ds"), F.col("timestamp").alias("ts"), F.col("rx_total").cast("double").alias("value"))
    return series.counter_rate(totals).select("ts", F.round("rate", 6).alias("rate"))


@query(_DELTA + ", shown AS (SELECT ds, bucket_ts * 1000 AS ms, round(CASE WHEN ds = 'rx_count' THEN delta ELSE coalesce(value, 0) END, 6) AS value FROM deltas) SELECT ds AS type, CASE ds WHEN 'rx_count' THEN 'Received Packets' ELSE 'Average SNR (dB)' END AS name, count(*) AS points, min(ms) AS first_ms, round(sum(value), 4) AS total FROM shown GROUP BY ds")
def metrics_graph(spark, sf):
    g = series.metrics_graph(V.packets(spark, sf), SINCE, V.NOW, metrics="rx_count, nonsense ,avg_snr")
    total = F.aggregate("data", F.lit(0.0), lambda acc, p: acc + p[1])
    return g.select("type", "name", F.size("data").cast("long").alias("points"), F.col("data")[0][0].cast("long").alias("first_ms"), F.round(total, 4).alias("total"))


@query(_rolled(60) + f"SELECT bucket_ts, ds, round(most, 12) AS value FROM rolled WHERE bucket_ts >= {SINCE} AND bucket_ts < {V.NOW}")
def rrd_fetch(spark, sf):
    return series.fetched(V.packets(spark, sf), SINCE, V.NOW, "max").withColumn("value", F.round("value", 12))


@query(_rolled(3600) + "SELECT ds, CASE WHEN count(average) >= 2 THEN max(average) - min(average) WHEN count(average) = 1 THEN max(average) ELSE 0.0 END AS total FROM rolled WHERE ds LIKE 'type_%' GROUP BY ds HAVING (SELECT count(average) FROM rolled WHERE ds LIKE 'type_%') >= 10")
def rrd_type_totals(spark, sf):
    values = series.rollup(V.packets(spark, sf), 3600).filter(F.col("ds").startswith("type_")).select("bucket_ts", "ds", F.col("average").alias("value"))
    return series.type_totals(values)


@query(_rolled(60) + f"SELECT count(*) AS kept FROM rolled WHERE bucket_ts > {V.NOW - 60 * 10080}")
def archive_retention(spark, sf):
    return series.kept(series.rollup(V.packets(spark, sf)), 60, "AVERAGE", V.NOW).agg(F.count(F.lit(1)).alias("kept"))


# Stateful


@query("SELECT id, round(sum(airtime_ms) OVER (ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 3) AS window_airtime_ms FROM packets")
def airtime_rolling(spark, sf):
    return stateful.rolling_airtime(V.packets(spark, sf))


_TTL = 86_400.0 * 20


@query()
def dedup_ttl(spark, sf):
    return stateful.dedup_ttl(V.packets(spark, sf), _TTL)


_SQL["dedup_ttl"] = (
    f"WITH RECURSIVE {V.SQL}, o AS (SELECT id, packet_hash, timestamp, row_number() OVER (PARTITION BY packet_hash ORDER BY timestamp, id) AS n FROM packets), "
    f"f AS (SELECT id, packet_hash, timestamp, n, true AS admitted, timestamp AS last FROM o WHERE n = 1 UNION ALL SELECT o.id, o.packet_hash, o.timestamp, o.n, o.timestamp - f.last > {_TTL}, CASE WHEN o.timestamp - f.last > {_TTL} THEN o.timestamp ELSE f.last END FROM f JOIN o ON o.packet_hash = f.packet_hash AND o.n = f.n + 1) "
    "SELECT id, packet_hash, admitted FROM f"
)


def _ttl_sql(key: str, ttl: float, out: str) -> str:
    """Admissions of a key's packets, each more than ttl after the one before."""
    return (
        f"WITH RECURSIVE {V.SQL}, o AS (SELECT id, {key} AS key, timestamp, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS n FROM packets), "
        f"f AS (SELECT id, key, timestamp, n, true AS admitted, timestamp AS last FROM o WHERE n = 1 UNION ALL SELECT o.id, o.key, o.timestamp, o.n, o.timestamp - f.last > {ttl}, CASE WHEN o.timestamp - f.last > {ttl} THEN o.timestamp ELSE f.last END FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1) "
        f"SELECT {out} FROM f"
    )


@query()
def key_cache_refreshes(spark, sf):
    return stateful.cache_refreshes(V.packets(spark, sf), "src_hash", 86_400.0 * 2)


_SQL["key_cache_refreshes"] = _ttl_sql("src_hash", 86_400.0 * 2, "id, key AS src_hash, admitted AS refreshed")


@query()
def dedup_fifo(spark, sf):
    p = V.packets(spark, sf).withColumn("packet_hash", (F.col("id") % 29).cast("string"))
    return stateful.dedup_fifo(p, "src_hash", 10).select("id", "admitted")


_SQL["dedup_fifo"] = (
    f"WITH RECURSIVE {V.SQL}, o AS (SELECT id, src_hash AS node, id % 29 AS h, row_number() OVER (PARTITION BY src_hash ORDER BY timestamp, id) AS n FROM packets), "
    "f AS (SELECT id, node, n, true AS admitted, [h] AS held FROM o WHERE n = 1 UNION ALL SELECT o.id, o.node, o.n, NOT list_contains(f.held, o.h), "
    "CASE WHEN list_contains(f.held, o.h) THEN f.held ELSE list_append(f.held, o.h)[-10:] END FROM f JOIN o ON o.node = f.node AND o.n = f.n + 1) SELECT id, admitted FROM f"
)


@query()
def duty_cycle_admit(spark, sf):
    sent = V.packets(spark, sf).withColumn("node", F.col("src_hash"))
    return stateful.duty_cycle(sent, "node", 36_000.0, 86_400.0).select("id", "admitted", F.round("wait_s", 6).alias("wait_s"))


_SQL["duty_cycle_admit"] = (
    f"WITH RECURSIVE {V.SQL}, o AS (SELECT id, src_hash AS node, timestamp AS t, CAST(round(airtime_ms * 1000) AS BIGINT) AS a, row_number() OVER (PARTITION BY src_hash ORDER BY timestamp, id) AS n FROM packets), "
    "f AS (SELECT id, node, n, a <= 36000000 AS admitted, CAST(CASE WHEN a <= 36000000 THEN 0 ELSE 1 END AS DOUBLE) AS wait_s, CASE WHEN a <= 36000000 THEN [{'t': t, 'a': a}] ELSE [] END AS held FROM o WHERE n = 1 "
    "UNION ALL SELECT id, node, n, ok, CASE WHEN ok THEN 0.0 WHEN len(kept) > 0 THEN greatest(0.0, kept[1].t + 86400.0 - t) ELSE 1.0 END, CASE WHEN ok THEN list_append(kept, {'t': t, 'a': a}) ELSE kept END "
    "FROM (SELECT *, coalesce(list_sum(list_transform(kept, lambda x: x.a)), 0) + a <= 36000000 AS ok FROM (SELECT o.*, list_filter(f.held, lambda x: o.t - x.t < 86400.0) AS kept FROM f JOIN o ON o.node = f.node AND o.n = f.n + 1))) "
    "SELECT id, admitted, round(wait_s, 6) AS wait_s FROM f"
)


# Records as nodes make them


def _bytes(df: DataFrame) -> DataFrame:
    """Packets with their header as a number and their path as bytes."""
    return df.withColumn("number", F.conv(F.substring("header", 3, 2), 16, 10).cast("int")).withColumn("hops", F.transform("original_path", lambda x: F.conv(x, 16, 10).cast("int")))


@query(
    f""", r AS (SELECT *, CASE WHEN id % 50 <> 0 THEN (id % 18) % 16 * 4 + (length - 1) % 4 END AS number, CASE WHEN id % 40 <> 0 THEN payload END AS body FROM packets),
    k AS (SELECT *, coalesce(number // 4, 0) AS kind, CASE WHEN body IS NULL THEN 0 ELSE 12 END AS size FROM r)
    SELECT timestamp, CASE WHEN number IS NOT NULL THEN header END AS header, body AS payload, CAST(size AS INTEGER) AS payload_length, CAST(kind AS INTEGER) AS type, CAST(coalesce(number % 4, 0) AS INTEGER) AS route, CAST(size AS INTEGER) AS length,
        rssi, CAST(snr AS DOUBLE) AS snr, round(CASE WHEN snr < -10 THEN 0.0 ELSE greatest(0.0, least(1.0, (snr + 10) / 10 * (1 - size / 256.0))) END, 9) AS score, tx_delay_ms, transmitted, is_duplicate, packet_hash,
        CASE WHEN drop_reason LIKE 'Direct%' THEN drop_reason WHEN is_duplicate THEN 'Duplicate' END AS drop_reason,
        CASE WHEN len(original_path) > 8 THEN '[' || array_to_string(original_path[1:8], ', ') || ', ...]' WHEN len(original_path) > 0 THEN '[' || array_to_string(original_path, ', ') || ']' END AS path_hash,
        CASE WHEN kind IN (0, 1, 2, 8) THEN upper(substr(body, 3, 2)) WHEN kind = 4 THEN upper(substr(body, 1, 2)) END AS src_hash, CASE WHEN kind IN (0, 1, 2, 8) THEN upper(substr(body, 1, 2)) END AS dst_hash,
        CASE WHEN id % 3 <> 0 THEN {_LIST} END AS original_path, CASE WHEN transmitted THEN {_LIST} END AS forwarded_path, raw_packet FROM k"""
)
def packet_records(spark, sf):
    p = _bytes(V.packets(spark, sf))
    received = p.select(
        "timestamp", F.when(F.col("id") % 50 != 0, F.col("number")).alias("header"), F.when(F.col("id") % 40 != 0, F.col("payload")).otherwise("").alias("payload"), F.col("raw_packet").alias("raw"), F.col("hops").alias("path"),
        F.md5((F.col("id") % 5000).cast("string").cast("binary")).alias("packet_hash"), "rssi", "snr", "transmitted", "tx_delay_ms", F.when(F.col("drop_reason").startswith("Direct"), F.col("drop_reason")).alias("drop_reason"),
        F.when(F.col("id") % 3 != 0, F.col("hops")).alias("original_path"), F.when(F.col("transmitted"), F.col("hops")).alias("forwarded_path"), F.col("is_duplicate").alias("seen"),
    )
    out = records.packet_records(received)
    return out.withColumns({c: F.array_join(c, ",") for c in ("original_path", "forwarded_path")}).withColumn("score", F.round("score", 9))


@query(
    f""", r AS (SELECT *, list_transform(range(0, CAST(least(id % 7, 5) AS BIGINT)), lambda i: (id + i * 37) % 256) AS b FROM packets WHERE type = 9)
    SELECT timestamp, header, CAST(9 AS INTEGER) AS type, transmitted AND false AS transmitted, 'trace_received' AS drop_reason,
        coalesce(CASE WHEN len(original_path) > 8 THEN '[' || array_to_string(original_path[1:8], ', ') || ', ...]' WHEN len(original_path) > 0 THEN '[' || array_to_string(original_path, ', ') || ']' END, '[]') AS path_hash,
        {_LIST} AS original_path, true AS is_trace,
        coalesce(array_to_string(list_transform(b, lambda x: printf('%d(%.1fdB)', x, CASE WHEN x > 127 THEN x - 256 ELSE x END / 4.0)), ';'), '') AS path_snrs,
        coalesce(array_to_string(list_transform(range(1, least(len(b), coalesce(len(original_path), 0)) + 1), lambda i: original_path[i] || ':' || b[i] || ':' || CAST((CASE WHEN b[i] > 127 THEN b[i] - 256 ELSE b[i] END * 25) AS BIGINT)), ';'), '') AS details FROM r"""
)
def trace_records(spark, sf):
    p = _bytes(V.packets(spark, sf).filter("type = 9"))
    gathered = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("id") + i * 37) % 256).cast("int"))
    received = p.select("timestamp", F.col("number").alias("header"), "payload", F.col("raw_packet").alias("raw"), gathered.alias("path"), (F.col("id") % 7).cast("int").alias("path_length"), F.col("hops").alias("trace_path"), "packet_hash", "rssi", "snr")
    out = records.trace_records(received)
    detail = lambda d: F.concat_ws(":", d["hash"], d["snr_raw"].cast("string"), (d["snr_db"] * 100).cast("long").cast("string"))
    return out.select("timestamp", "header", "type", "transmitted", "drop_reason", "path_hash", F.array_join("original_path", ",").alias("original_path"), "is_trace", F.array_join("path_snrs", ";").alias("path_snrs"), F.array_join(F.transform("path_snr_details", detail), ";").alias("details"))


_RING = ", r AS (SELECT *, row_number() OVER (PARTITION BY packet_hash ORDER BY timestamp, id) AS n FROM packets), ring AS (SELECT * FROM r WHERE n = 1 ORDER BY timestamp DESC, id DESC LIMIT 50) "
SETTINGS = {"repeater": {"node_name": "hill", "latitude": 47.5}, "radio": {"spreading_factor": 8, "bandwidth": 62_500}, "duty_cycle": {"max_airtime_per_minute": 1800}}


@query(_RING + f"SELECT count(*) FILTER (timestamp > {V.NOW - 3600}) AS rx_per_hour, count(*) FILTER (transmitted AND timestamp > {V.NOW - 3600}) AS forwarded_per_hour FROM ring")
def hourly_rates_of_ring(spark, sf):
    return summaries.hourly_rates(V.packets(spark, sf), V.NOW, ring=50)


@query(
    _RING
    + f"""SELECT '0xab' AS local_hash, CAST(60 AS INTEGER) AS cache_ttl, 3600.0 AS uptime_seconds, (SELECT count(*) FROM packets) AS rx_count, (SELECT count(*) FROM packets WHERE transmitted) AS forwarded_count, (SELECT count(*) FROM packets WHERE NOT transmitted) AS dropped_count,
        (SELECT count(*) FROM ring WHERE timestamp > {V.NOW - 3600}) AS rx_per_hour, (SELECT count(*) FROM ring) AS ring, (SELECT id FROM ring ORDER BY timestamp DESC, id DESC LIMIT 1) AS newest, (SELECT count(DISTINCT pubkey) FROM advert_events) AS neighbours,
        (SELECT arg_max(node_name, timestamp) FROM advert_events WHERE pubkey = md5('7')) AS name_of_7, (SELECT noise_floor_dbm FROM noise_floor ORDER BY timestamp DESC, id DESC LIMIT 1) AS noise_floor_dbm, (SELECT count(DISTINCT packet_hash) FROM packets) AS duplicate_cache_size,
        'hill' AS node_name, 'forward' AS mode, 47.5 AS latitude, CAST(8 AS INTEGER) AS spreading_factor, 3.0 AS max_airtime_percent, true AS enforcement_enabled, 0.5 AS direct_tx_delay_factor"""
)
def live_stats(spark, sf):
    import hashlib

    s = summaries.live_stats(V.packets(spark, sf), V.advert_events(spark, sf), V.noise_floor(spark, sf), SETTINGS, V.NOW, V.NOW - 3600, 0xAB)
    c = lambda path: F.col(f"config.{path}").alias(path.split(".")[-1])
    return s.select(
        "local_hash", "cache_ttl", "uptime_seconds", "rx_count", "forwarded_count", "dropped_count", "rx_per_hour", F.size("recent_packets").cast("long").alias("ring"), F.col("recent_packets")[0]["id"].alias("newest"),
        F.size("neighbors").cast("long").alias("neighbours"), F.col("neighbors")[hashlib.md5(b"7").hexdigest()]["node_name"].alias("name_of_7"), "noise_floor_dbm", "duplicate_cache_size", c("node_name"), c("repeater.mode"), c("repeater.latitude"),
        c("radio.spreading_factor"), F.round("config.duty_cycle.max_airtime_percent", 9).alias("max_airtime_percent"), c("duty_cycle.enforcement_enabled"), c("delays.direct_tx_delay_factor"),
    )


@query(
    f"""SELECT count(*) AS total_packets, CAST(sum(CAST(transmitted AS INT)) AS BIGINT) AS transmitted_packets, CAST(sum(1 - CAST(transmitted AS INT)) AS BIGINT) AS dropped_packets,
        round_even(coalesce(avg(rssi), 0), 1) AS avg_rssi, round_even(coalesce(avg(snr), 0), 1) AS avg_snr, round_even(coalesce(avg(score), 0), 3) AS avg_score,
        round_even(coalesce(avg(payload_length), 0), 1) AS avg_payload_length, round_even(coalesce(avg(tx_delay_ms), 0), 1) AS avg_tx_delay FROM packets WHERE timestamp > {SINCE}"""
)
def packet_stats_half_even(spark, sf):
    return summaries.packet_stats(V.packets(spark, sf), HOURS, V.NOW, half_even=True)


# Series as they are kept


@query(_rolled(60) + "SELECT bucket_ts, ds, samples, round(average, 9) AS average, round(least, 9) AS least, round(most, 9) AS most FROM rolled")
def series_update(spark, sf):
    """The stored part, and a batch that begins a day before it ends: what comes again is skipped."""
    p, cut = V.packets(spark, sf), V.NOW - 5 * 86400
    old = p.filter(F.col("timestamp") < cut)
    last = old.agg(F.max(F.floor(F.col("ts_us") / 1_000_000))).first()[0]
    out = series.updated(series.rollup(old), p.filter(F.col("timestamp") >= cut - 86400), int(last))
    return out.select("bucket_ts", "ds", "samples", *(F.round(c, 9).alias(c) for c in ("average", "least", "most")))


_ROLLED_DAY = _rolled(60).replace(", rolled AS", f", {_DAY}, rolled AS").replace("FROM fed GROUP", "FROM fed_day GROUP")
_TYPE_CASE = "CASE ds " + " ".join(f"WHEN 'type_{k}' THEN '{v}'" for k, v in codes.TYPE_NAMES.items()) + f" WHEN 'type_other' THEN '{codes.OTHER_TYPES}' END"


@query(_ROLLED_DAY + f"SELECT {_TYPE_CASE} AS name, CAST(greatest(0.0, CASE WHEN count(average) >= 2 THEN max(average) - min(average) ELSE max(average) END) AS BIGINT) AS count FROM rolled WHERE ds LIKE 'type_%' GROUP BY ds")
def packet_type_stats_of_series(spark, sf):
    return series.type_stats_of_series(V.packets(spark, sf), HOURS, V.NOW)


@query(f"SELECT name, count FROM ({_TYPES})")
def packet_type_stats_fallback(spark, sf):
    return series.type_stats_of_series(V.packets(spark, sf), HOURS, V.NOW, least_points=10**9)


@query(_rolled(3600) + "SELECT CASE WHEN ds LIKE 'type_%' THEN 'packet_types' ELSE 'metrics' END AS part, count(*) AS points, count(DISTINCT ds) AS sources FROM rolled GROUP BY 1")
def series_parts(spark, sf):
    parts = series.partitioned(series.rollup(V.packets(spark, sf), 3600))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("ds").alias("sources"))


def _values(rows, names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


@query(_values([(n, k, 120, low, high) for n, k, low, high in codes.SOURCES], "ds, kind, heartbeat, least, most"))
def series_sources(spark, sf):
    return series.sources(spark)


@query(_values(series.ARCHIVES, "cf, step, slots"))
def series_archives(spark, sf):
    return series.archives(spark)


# Messages


@query(
    """SELECT '{"status":"online","timestamp":"2024-01-31T00:00:00+00:00","origin":"hill","origin_id":"KEY","model":"M","firmware_version":"1","radio":"869.618,62.5,8,8","client_version":"c/1","stats":{"uptime_secs":3600,"packets_sent":'
        || count(*) FILTER (transmitted) || ',"packets_received":' || count(*) || ',"errors":0,"queue_len":0},"location":{"latitude":47.5,"longitude":8.25}}' AS payload FROM packets"""
)
def status_heartbeat(spark, sf):
    counters = V.packets(spark, sf).agg(F.count(F.lit(1)).alias("rx_count"), F.count_if("transmitted").alias("forwarded_count"))
    row = publish.status(counters, "hill", "KEY", V.NOW, V.NOW - 3600, model="M", version="1", client="c/1", radio="869.618,62.5,8,8", location=(47.5, 8.25))
    return row.select(F.to_json(F.struct("*")).alias("payload"))


@query("""SELECT id, '{"timestamp":"2024-01-31T00:00:00+00:00","origin_id":"KEY","type":"raw","data":"' || raw_packet || '","bytes":' || length(raw_packet) // 2 || '}' AS payload FROM packets""")
def publish_raw(spark, sf):
    return publish.as_json(publish.wrapped(publish.raw_records(V.packets(spark, sf)), "KEY", V.NOW))


@query("""SELECT id, 'mesh/hill/advert' AS topic, '{"pubkey":"' || pubkey || '"' || CASE WHEN contact_type = 'UNKNOWN' THEN '' ELSE ',"contact_type":"' || contact_type || '"' END || '}' AS payload FROM advert_events""")
def publish_messages(spark, sf):
    a = V.advert_events(spark, sf).select("id", "pubkey", F.nullif("contact_type", F.lit("UNKNOWN")).alias("contact_type"))
    return publish.messages(a, "mesh", "hill", "advert")


@query(f"SELECT CASE WHEN id % 4 = 0 THEN {float(V.NOW)} ELSE timestamp END AS timestamp, CAST(noise_floor_dbm AS DOUBLE) AS noise_floor_dbm FROM noise_floor WHERE id % 7 <> 0")
def store_noise_floor(spark, sf):
    n = V.noise_floor(spark, sf)
    return publish.noise_record(n.select(F.when(F.col("id") % 4 != 0, F.col("timestamp")).alias("timestamp"), F.when(F.col("id") % 7 != 0, F.col("noise_floor_dbm")).alias("noise_floor_dbm")), V.NOW)


@query(f"SELECT CAST(t AS DOUBLE) AS timestamp, 'hill' AS node_name, upper(substr(md5('KEY:' || t), 1, 16)) AS packet_hash FROM range({SINCE}, {V.NOW}, 36000) r(t)")
def own_adverts(spark, sf):
    return publish.own_adverts(spark, {"pubkey": "KEY", "node_name": "hill"}, SINCE, V.NOW, 10).select("timestamp", "node_name", "packet_hash")


@query("""SELECT '{"success":true,"data":[' || string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' ORDER BY id) || '],"count":' || count(*) || '}' AS response FROM transport_keys WHERE id < 6""")
def response_envelope(spark, sf):
    return publish.envelope(V.transport_keys(spark, sf).filter("id < 6").select("id", "name"))


@query("""SELECT id AS seq, 'data: {"type":"progress","cell":' || id || '}' || chr(10) || chr(10) AS event FROM packets WHERE id >= 900 AND id < 5000""")
def sse_events(spark, sf):
    queue = V.packets(spark, sf).filter("id < 5000").select(F.col("id").alias("seq"), F.to_json(F.struct(F.lit("progress").alias("type"), F.col("id").alias("cell"))).alias("payload"))
    return messages.events(queue, 900)


# Settings, timers, texts


@query(_values([("radio.spreading_factor", "8"), ("radio.bandwidth", "62500"), ("repeater.mode", '"forward"'), ("repeater.latitude", "47.5"), ("repeater.node_name", '"hill"'), ("duty_cycle.max_airtime_per_minute", "1800"), ("extra", "null")], "path, value"))
def config_merge(spark, sf):
    default = {"radio": {"spreading_factor": 7, "bandwidth": 62_500}, "repeater": {"mode": "forward", "latitude": 0.0}, "extra": None}
    return config.flat(spark, config.merged(default, SETTINGS))


@query(_values([("hours", "12"), ("limit", "100"), ("share", "0.5"), ("types", '"all"')], "path, value"))
def request_parameters(spark, sf):
    return config.flat(spark, config.coerced({"hours": "12", "share": "0.5", "types": "all"}, {"hours": 24, "limit": 100, "share": 0.1, "types": None}))


_PRESETS = '{"config": {"suggested_radio_settings": {"entries": [{"title": "EU narrow", "frequency": "869.618", "spreading_factor": "8", "bandwidth": "62.5", "coding_rate": "8"}, {"title": "US", "frequency": "910.525"}]}}}'


@query("SELECT 'EU narrow' AS title, '869.618' AS frequency, '8' AS spreading_factor UNION ALL SELECT 'US', '910.525', ''")
def radio_presets(spark, sf):
    found = config.presets_of(spark.createDataFrame([(_PRESETS,), ("{}",)], "value string"))
    return found.select("title", "frequency", F.coalesce("spreading_factor", F.lit("")).alias("spreading_factor"))


@query(f"SELECT t AS at, (t - {SINCE}) % 30 = 0 AS due FROM range({SINCE}, {V.NOW}, 5) r(t)")
def timer_checks(spark, sf):
    return poller.due(spark, SINCE, V.NOW)


@query("SELECT id, '869.618,62.5,' || id % 6 + 7 || ',8' AS radio, round(id * 123457 / 1024 / 1024, 1) AS mb, CASE WHEN id % 2 = 0 THEN 'chip' ELSE 'chip_' || id % 3 END AS sensor FROM packets")
def host_texts(spark, sf):
    i = F.col("id")
    return V.packets(spark, sf).select("id", text.radio_text(F.lit(869.618), F.lit(62.5), i % 6 + 7, F.lit(8)).alias("radio"), text.megabytes(i * 123457).alias("mb"), text.sensor_name(F.lit("chip"), i % 3, i % 2 + 1).alias("sensor"))


@query("SELECT id, round(timestamp + id % 50 / 10.0, 6) AS scheduled_ts FROM packets")
def delayed_emission(spark, sf):
    return ingest.scheduled(V.packets(spark, sf), F.col("id") % 50 / 10.0).select("id", F.round("scheduled_ts", 6).alias("scheduled_ts"))


# Streams, run until all is read


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query()
def stream_dedup(spark, sf):
    """The packet stream through exact_copies() into a table."""
    path = _folder(spark, "stream-dedup")
    stream = V.packets_of(V.event_stream(spark, sf)).withColumn("event_time", F.timestamp_seconds("timestamp"))
    writer = ingest.exact_copies(stream, _TTL).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("packet_hash string, id long, timestamp double, admitted boolean").parquet(f"{path}/rows").select("id", "packet_hash", "admitted")


_SQL["stream_dedup"] = _ttl_sql("packet_hash", _TTL, "id, key AS packet_hash, admitted")


@query("SELECT pubkey, min(id) AS id, arg_max(contact_type, timestamp) AS contact_type, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(count(*) AS INTEGER) AS advert_count FROM advert_events GROUP BY pubkey")
def stream_node_table(spark, sf):
    path = _folder(spark, "stream-nodes")
    schema = entities.advert_upsert(V.advert_events(spark, sf)).schema
    ingest.start(V.adverts_of(V.event_stream(spark, sf)).drop("ts", "ts_us"), ingest.upsert_adverts(f"{path}/nodes", schema), f"{path}/state").awaitTermination()
    return ingest.node_table(spark, f"{path}/nodes", schema).select("pubkey", "id", "contact_type", "first_seen", "last_seen", "advert_count")


@query(_rolled(60) + "SELECT bucket_ts, ds, samples, round(average, 9) AS average FROM rolled")
def stream_series(spark, sf):
    path = _folder(spark, "stream-series")
    ingest.start(V.packets_of(V.event_stream(spark, sf)), ingest.update_series(f"{path}/series"), f"{path}/state").awaitTermination()
    return ingest.series_table(spark, f"{path}/series").select("bucket_ts", "ds", "samples", F.round("average", 9).alias("average"))
