"""Nodes, copies of packets, transport keys: joins, upserts and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.operators.reads import bound, latest_per_key
from tidemesh.schemas import POLICIES

ATTRIBUTES = ("timestamp", "node_name", "is_repeater", "route_type", "contact_type", "latitude", "longitude", "rssi", "snr", "zero_hop")


def advert_upsert(adverts: DataFrame) -> DataFrame:
    """The node table after all adverts: one row for each pubkey with the latest attributes, first and last time, and number of adverts.

    One aggregation that combines before the shuffle; of adverts of one time the larger id is later.
    """
    latest = F.max_by(F.struct(*ATTRIBUTES), F.struct("timestamp", "id")).alias("latest")
    return (
        adverts.groupBy("pubkey")
        .agg(F.min("id").alias("id"), latest, F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).cast("int").alias("advert_count"))
        .select("id", "pubkey", "latest.*", "first_seen", "last_seen", "advert_count", (F.col("advert_count") == 1).alias("is_new_neighbor"))
    )


def merged(table: DataFrame, adverts: DataFrame) -> DataFrame:
    """An existing node table with a batch of adverts taken in; tables that only append have no MERGE, so both are aggregated."""
    new = advert_upsert(adverts)
    columns = table.columns
    both = table.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    kept = [c for c in columns if c not in ("id", "pubkey", "first_seen", "last_seen", "advert_count", "is_new_neighbor")]
    latest = F.max_by(F.struct(*kept), F.struct("last_seen", "_new")).alias("latest")
    out = both.groupBy("pubkey").agg(F.min("id").alias("id"), latest, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("advert_count").cast("int").alias("advert_count"))
    return out.select("id", "pubkey", "latest.*", "first_seen", "last_seen", "advert_count", (F.col("advert_count") == 1).alias("is_new_neighbor")).select(*columns)


def neighbors_latest(adverts: DataFrame) -> DataFrame:
    """Each node's latest advert, most recent node first: a ranking instead of a join with the nodes' maxima."""
    return latest_per_key(adverts, "pubkey", [F.desc("timestamp"), F.desc("id")]).orderBy(F.desc("timestamp"), F.desc("id"))


def first_seen_neighbors(adverts: DataFrame, known: DataFrame) -> DataFrame:
    """The first advert of each node that isn't in ``known`` (pubkey)."""
    return latest_per_key(adverts.join(known.select("pubkey").distinct(), "pubkey", "left_anti"), "pubkey", [F.asc("timestamp"), F.asc("id")])


def already_seen(packets: DataFrame, seen: DataFrame) -> DataFrame:
    """Packets whose hash is among ``seen`` (packet_hash)."""
    return packets.join(seen.select("packet_hash").distinct(), "packet_hash", "left_semi")


def duplicates_nested(packets: DataFrame, most: int | None = None) -> DataFrame:
    """The first packet of each hash, the number of its later ones, and all of them as a list in order of time; with ``most`` only the first so many.

    One aggregation; without the list it combines before the shuffle. Packets without a time come last. Of those without a hash
    the first is returned, without copies, as nothing says that they are the same.
    """
    known = F.col("packet_hash").isNotNull()
    columns = ("timestamp", "id", "rssi", "snr")
    copy = F.struct(F.col("timestamp").isNull().alias("untimed"), *columns)
    rank = F.row_number().over(Window.partitionBy("packet_hash").orderBy(F.asc_nulls_last("timestamp"), "id"))
    rows = packets.select("packet_hash", "type", copy.alias("copy"), F.when(known if most is None else known & (rank <= most + 1), copy).alias("nested"))
    grouped = rows.groupBy("packet_hash").agg(
        F.min(F.struct("copy", "type")).alias("first"),
        F.when(known, F.count(F.lit(1)) - 1).otherwise(0).cast("int").alias("duplicate_count"),
        F.sort_array(F.collect_list("nested")).alias("all"),
    )
    later = F.when(F.size("all") > 1, F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: F.struct(*(x[c].alias(c) for c in columns))))
    first = F.col("first.copy")
    return grouped.select(first["id"].alias("id"), first["timestamp"].alias("timestamp"), "packet_hash", F.col("first.type").alias("type"), first["rssi"].alias("rssi"), first["snr"].alias("snr"), "duplicate_count", later.alias("duplicates"))


def match_transport_key(packets: DataFrame, keys: DataFrame, expected: Column, most_keys: int = 10_000) -> DataFrame:
    """Each packet's verdict: allow, deny, or none if no key gives its code.

    expected: the code that a key gives for a packet, over columns of both; it replaces the radio library's function, which isn't
    known here. The first key by creation wins. The keys are an administrator's list: they are broadcast up to ``most_keys``, beyond
    which the call is refused. Packets without a code are left out.
    """
    if keys.limit(most_keys + 1).count() > most_keys:
        raise ValueError(f"over {most_keys} transport keys")
    named = keys.select(F.col("id").alias("key_id"), F.col("name").alias("key_name"), "flood_policy", "transport_key", "created_at")
    coded = packets.filter(F.col("transport_code").isNotNull())
    hit = coded.join(F.broadcast(named), F.col("transport_code") == expected, "left")
    first = F.min_by(F.struct("key_id", "key_name", "flood_policy"), F.struct("created_at", "key_id"))
    best = hit.groupBy("id", "transport_code").agg(first.alias("key"))
    return best.select("id", "transport_code", "key.key_name", F.coalesce("key.flood_policy", F.lit("none")).alias("verdict"))


def last_use(matches: DataFrame, packets: DataFrame) -> DataFrame:
    """When each key was last matched."""
    return matches.filter(F.col("key_name").isNotNull()).join(packets.select("id", "timestamp"), "id").groupBy("key_name").agg(F.max("timestamp").alias("last_used"))


def inserted(keys: DataFrame, rows: DataFrame) -> DataFrame:
    return keys.unionByName(rows.select(*keys.columns))


def updated(keys: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """Keys with the non-null fields of ``changes`` (id and some columns) put in; so a field can't be set to null."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    columns = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.when(F.col("_hit"), F.lit(float(now))).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in keys.columns]
    return keys.join(new, "id", "left").select(*columns)


def deleted(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def key_violations(keys: DataFrame) -> DataFrame:
    """Rows that the stored table would refuse: missing fields, an unknown policy, a name used twice."""
    twice = keys.groupBy("name").count().filter("count > 1").select("name", F.lit(True).alias("_twice"))
    problem = (
        F.when(F.col("name").isNull() | F.col("transport_key").isNull(), "missing field")
        .when(F.col("flood_policy").isNull() | ~F.col("flood_policy").isin(*POLICIES), "unknown policy")
        .when(F.col("_twice"), "name used twice")
    )
    return keys.join(twice, "name", "left").withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_twice")


def key_tree(keys: DataFrame, most_levels: int = 1000) -> DataFrame:
    """id, name, depth and path of each key, from the roots down: a recursive query, which ends where a level is empty.

    Keys below a root that are their own ancestors, which takes an id that is used twice, would go on for ever: the query
    fails for them, and for trees of more than ``most_levels`` levels.
    """
    return keys.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(id, name, depth, path, ids) MAX RECURSION LEVEL {int(most_levels)} AS (
            SELECT id, name, 0, name, array(id) FROM {{keys}} WHERE parent_id IS NULL
            UNION ALL
            SELECT k.id, k.name, t.depth + 1, concat_ws('/', t.path, k.name),
                if(array_contains(t.ids, k.id), raise_error('a key is its own ancestor'), array_append(t.ids, k.id))
            FROM tree t JOIN {{keys}} k ON k.parent_id = t.id
        )
        SELECT id, name, depth, path FROM tree
        """,
        keys=keys,
    )


def with_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """A migration: adds the column where it is missing, and does nothing the second time."""
    return df if name in df.columns else df.withColumn(name, default)


def retained(df: DataFrame, days: float, now: float) -> DataFrame:
    """What cleaning up leaves: rows not older than ``days``."""
    time, low = bound(df, now - days * 86400)
    return df.filter(time >= low)


def paired(path: Column, values: Column) -> Column:
    """[(hop, value), ...] by position; the shorter list decides."""
    both = F.transform(path, lambda hop, i: F.struct(hop.alias("hop"), F.get(values, i).alias("value")))
    return F.slice(both, F.lit(1), F.least(F.size(path), F.size(values)))
