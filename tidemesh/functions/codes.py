"""Names of packet types, routes and metrics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the packet type and route codes and of the metrics, as users of the stored data expect them.
TYPE_NAMES = {
    0: "Request (REQ)",
    1: "Response (RESPONSE)",
    2: "Plain Text Message (TXT_MSG)",
    3: "Acknowledgment (ACK)",
    4: "Node Advertisement (ADVERT)",
    5: "Group Text Message (GRP_TXT)",
    6: "Group Datagram (GRP_DATA)",
    7: "Anonymous Request (ANON_REQ)",
    8: "Returned Path (PATH)",
    9: "Trace (TRACE)",
    10: "Multi-part Packet",
    11: "Reserved Type 11",
    12: "Reserved Type 12",
    13: "Reserved Type 13",
    14: "Reserved Type 14",
    15: "Custom Packet (RAW_CUSTOM)",
}
#: Codes by the short names in the labels' parentheses.
TYPE_CODES = {label.split("(")[1].rstrip(")"): code for code, label in TYPE_NAMES.items() if "(" in label}
OTHER_TYPES = "Other Types (>15)"
ROUTE_NAMES = {0: "Transport Flood", 1: "Flood", 2: "Direct", 3: "Transport Direct"}
OTHER_ROUTES = "Other Routes (>3)"
METRIC_NAMES = {
    "rx_count": "Received Packets",
    "tx_count": "Transmitted Packets",
    "drop_count": "Dropped Packets",
    "avg_rssi": "Average RSSI (dBm)",
    "avg_snr": "Average SNR (dB)",
    "avg_length": "Average Packet Length",
    "avg_score": "Average Score",
    "neighbor_count": "Neighbor Count",
}
COUNTERS = ("rx_count", "tx_count", "drop_count")
#: Gauges and the range outside of which a sample is unknown.
GAUGES = {"avg_rssi": ("rssi", -200.0, 0.0), "avg_snr": ("snr", -30.0, 30.0), "avg_length": ("length", 0.0, 256.0), "avg_score": ("score", 0.0, 1.0)}
#: Seconds after which a source without a sample is unknown.
HEARTBEAT = 120
#: All sources of the series: (name, kind, least, most); null bounds are open.
SOURCES = (
    *((n, "COUNTER", 0.0, None) for n in COUNTERS),
    *((n, "GAUGE", low, high) for n, (_, low, high) in GAUGES.items()),
    ("neighbor_count", "GAUGE", 0.0, None),
    *((f"type_{i}", "COUNTER", 0.0, None) for i in range(16)),
    ("type_other", "COUNTER", 0.0, None),
)


def _lookup(names: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*chain(*((F.lit(k), F.lit(v)) for k, v in names.items()))), code)


def type_name(code: Column) -> Column:
    """Label of a type code; codes above 15 share one, others without a name are ``Type n``."""
    return F.when(code > 15, OTHER_TYPES).otherwise(F.coalesce(_lookup(TYPE_NAMES, code.cast("int")), F.concat(F.lit("Type "), code.cast("string"))))


def route_name(code: Column) -> Column:
    return F.when(code > 3, OTHER_ROUTES).otherwise(F.coalesce(_lookup(ROUTE_NAMES, code.cast("int")), F.concat(F.lit("Route "), code.cast("string"))))


def metric_name(key: Column) -> Column:
    return F.coalesce(_lookup(METRIC_NAMES, key), key)


def slug(label: Column) -> Column:
    """Small letters, underscores for spaces, no parentheses."""
    return F.translate(F.replace(F.lower(label), F.lit(" "), F.lit("_")), "()", "")
