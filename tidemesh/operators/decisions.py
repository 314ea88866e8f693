"""Why a packet isn't sent on: one ordered chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemesh.functions.signal import first_of

FLOOD, DIRECT = (0, 1), (2, 3)


def drop_reason(own_hash: str, most_hops: int, monitor: bool = False, flood_allowed: bool = True, local: Column | None = None, preset: Column | None = None, seen: Column | None = None, denied: Column | None = None, over_budget: Column | None = None) -> Column:
    """The reason, null for a packet that is sent. Over route, payload, original_path; the rest are columns of stateful or outer steps.

    local: injected by the node itself (no forwarding rule holds it back). preset: a reason set before (a text, null for none).
    seen: its hash was seen. denied: the transport keys' reason where floods aren't allowed. over_budget: the duty cycle is used up.
    """
    no, nothing = F.lit(False), F.lit(None).cast("string")
    local, preset, seen, denied, over = (x if x is not None else d for x, d in ((local, no), (preset, nothing), (seen, no), (denied, nothing), (over_budget, no)))
    route, hops = F.col("route"), F.coalesce(F.size("original_path"), F.lit(0))
    flood, direct = route.isin(*FLOOD) & ~local, route.isin(*DIRECT) & ~local
    return first_of(
        (F.lit(monitor), "Monitor mode"),
        (flood & (F.length(F.coalesce("payload", F.lit(""))) == 0), "Empty payload"),
        (flood & (hops >= most_hops), F.concat(F.lit("Path length "), hops.cast("string"), F.lit(f" exceeds MAX_PATH_SIZE ({most_hops})"))),
        (flood & preset.isNotNull(), preset),
        (flood & F.lit(not flood_allowed) & denied.isNotNull(), denied),
        (flood & seen, "Duplicate"),
        (direct & (hops == 0), "Direct: no path"),
        (direct & (F.get("original_path", F.lit(0)) != own_hash), "Direct: not for us"),
        (~local & ~route.isin(*FLOOD, *DIRECT), F.concat(F.lit("Unknown route type: "), route.cast("string"))),
        (over, "Duty cycle limit"),
    )


def forwarded_path(own_hash: str) -> Column:
    """A flood's path gains this node, a direct packet's loses its first hop."""
    path = F.coalesce("original_path", F.array().cast("array<string>"))
    return F.when(F.col("route").isin(*FLOOD), F.concat(path, F.array(F.lit(own_hash)))).when(F.col("route").isin(*DIRECT), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))))


def handler(kind: Column) -> Column:
    """Which part of the node reads a payload type first."""
    return F.when(kind == 9, "trace").when(kind == 11, "control").when(kind == 4, "advert").otherwise("repeater")
