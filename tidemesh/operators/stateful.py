"""Operators whose result for a row depends on what they decided before, as folds over each node's rows in order of time.

A key's rows stream through the fold in batches and only the state is held, so a node's history may be of any length.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_airtime(packets: DataFrame, window_us: int = 60_000_000, key: str | None = None) -> DataFrame:
    """Each packet's airtime sum over the trailing window, its own included; what is exactly as old as the window is out.

    Without a key (a table of one node) hours, or windows where these are longer, are the partitions: each also reads the window before it begins.
    """
    if key is not None:
        w = Window.partitionBy(key).orderBy("ts_us").rangeBetween(-(window_us - 1), 0)
        return packets.select("id", F.round(F.sum("airtime_ms").over(w), 3).alias("window_airtime_ms"))
    part_us = max(3_600_000_000, window_us)
    own = F.floor(F.col("ts_us") / part_us)
    late = F.pmod("ts_us", F.lit(part_us)) > part_us - window_us
    rows = packets.select("id", "ts_us", "airtime_ms", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("part"), own.alias("own"))
    w = Window.partitionBy("part").orderBy("ts_us").rangeBetween(-(window_us - 1), 0)
    return rows.withColumn("sum", F.sum("airtime_ms").over(w)).filter("part = own").select("id", F.round("sum", 3).alias("window_airtime_ms"))


def folded(df: DataFrame, key: str, columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """step(state, row) -> output row, over each key's rows (key, *columns) as sorted by key and columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out = []
            for k, *row in batch.itertuples(index=False, name=None):
                if k != current:
                    current, state = k, start()
                out.append((k, *step(state, tuple(row))))
            yield pd.DataFrame(out, columns=[key, *names])

    names = [x.split()[0] for x in schema.split(", ")]
    kind = dict(df.dtypes)[key]
    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}")


def admissions(times: np.ndarray, ttl: float, last: float | None) -> tuple[np.ndarray, float | None]:
    """(which of the ascending times are admitted, the last admission): each is more than ``ttl`` after the one before. Jumps from admission to admission."""
    out = np.zeros(len(times), dtype=bool)
    i = 0 if last is None else int(np.argmax(np.append(times - last > ttl, True)))
    while i < len(times):
        out[i], last = True, float(times[i])
        # By difference, as the rule is stated, and not by sums, which round otherwise.
        ahead = int(np.searchsorted(times, last + ttl, side="left"))
        while ahead > i + 1 and times[ahead - 1] - last > ttl:
            ahead -= 1
        ahead = max(ahead, i + 1)
        while ahead < len(times) and not times[ahead] - last > ttl:
            ahead += 1
        i = ahead
    return out, last


def dedup_ttl(packets: DataFrame, ttl_s: float = 60.0, key: str = "packet_hash") -> DataFrame:
    """id, admitted: a hash is a copy up to ``ttl_s`` after its last admission; copies don't prolong that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), None
        for batch in batches:
            if not len(batch):
                continue
            keys, times = batch[key].to_numpy(), batch["timestamp"].to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            fresh = np.empty(len(batch), dtype=bool)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)], strict=True):
                if keys[a] != current:
                    current, last = keys[a], None
                fresh[a:b], last = admissions(times[a:b], ttl_s, last)
            yield batch[[key, "id"]].assign(admitted=fresh)

    kind = dict(packets.dtypes)[key]
    return packets.select(key, "timestamp", "id").repartition(key).sortWithinPartitions(key, "timestamp", "id").mapInPandas(run, f"{key} {kind}, id long, admitted boolean").select("id", key, "admitted")


def cache_refreshes(lookups: DataFrame, node: str, ttl_s: float = 60.0) -> DataFrame:
    """id, refreshed: which lookups of a node find its cached table older than ``ttl_s`` and read it anew, the first one always."""
    return dedup_ttl(lookups, ttl_s, node).select("id", node, F.col("admitted").alias("refreshed"))


def dedup_fifo(packets: DataFrame, node: str, capacity: int = 1000) -> DataFrame:
    """id, admitted with a memory of the last ``capacity`` first occurrences of a node, however old; a copy keeps its place in it."""

    def step(state: OrderedDict, row: tuple) -> tuple:
        _, ident, packet_hash = row
        fresh = packet_hash not in state
        if fresh:
            state[packet_hash] = None
            if len(state) > capacity:
                state.popitem(last=False)
        return ident, fresh

    return folded(packets, node, ["timestamp", "id", "packet_hash"], OrderedDict, step, "id long, admitted boolean")


def duty_cycle(packets: DataFrame, node: str, budget_ms: float = 3600.0, window_s: float = 60.0, enforced: bool = True) -> DataFrame:
    """id, admitted, wait_s: sent if the node's airtime admitted in the trailing window leaves room; else when to try again.

    Only what was admitted counts, at the time it was admitted, in whole microseconds of airtime. Waiting is until the oldest
    leaves the window, 1 s if there is none.
    """
    budget = round(budget_ms * 1000)

    def step(state: list, row: tuple) -> tuple:
        at, ident, airtime = row
        if not enforced:
            return ident, True, 0.0
        if not state:
            state += [deque(), 0]
        held = state[0]
        while held and at - held[0][0] >= window_s:
            state[1] -= held.popleft()[1]
        if state[1] + airtime <= budget:
            held.append((at, airtime))
            state[1] += airtime
            return ident, True, 0.0
        return ident, False, max(0.0, held[0][0] + window_s - at) if held else 1.0

    rows = packets.withColumn("_airtime_us", F.round(F.col("airtime_ms") * 1000).cast("long"))
    return folded(rows, node, ["timestamp", "id", "_airtime_us"], list, step, "id long, admitted boolean, wait_s double")
