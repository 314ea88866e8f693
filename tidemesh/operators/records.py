"""Records as a node keeps them, built from packets as they were received.

A received packet has header (a byte, null if it has none), payload and raw (lower-case hexadecimal), path (bytes), packet_hash
(hexadecimal), rssi, snr and timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh.functions import text
from tidemesh.functions.signal import packet_score, snr_from_byte


def _hex_list(path: Column) -> Column:
    return F.transform(path, lambda b: text.hex_byte(b.cast("int")))


def _common(spreading_factor: int) -> dict[str, Column]:
    """The fields that all records share."""
    size = F.coalesce(text.hex_bytes(F.col("payload")), F.lit(0))
    return {
        "header": F.when(F.col("header").isNotNull(), text.header_text(F.col("header").cast("int"))),
        "payload": F.nullif("payload", F.lit("")),
        "payload_length": size,
        "type": F.coalesce(text.payload_type(F.col("header").cast("int")), F.lit(0)),
        "route": F.coalesce(F.col("header").cast("int").bitwiseAND(3), F.lit(0)),
        "length": size,
        "score": packet_score(F.col("snr"), size, spreading_factor),
        "packet_hash": text.hash_prefix(F.col("packet_hash")),
        "raw_packet": F.col("raw"),
    }


def packet_records(received: DataFrame, spreading_factor: int = 8) -> DataFrame:
    """timestamp and the twenty other fields of a stored packet.

    Besides the received packet: transmitted, tx_delay_ms, drop_reason (null for none), original_path and forwarded_path (bytes, null if the
    packet wasn't handled so far), seen (whether its hash is known). A seen packet that isn't sent on is a copy.
    """
    common = _common(spreading_factor)
    copy = F.col("seen") & ~F.col("transmitted")
    shown = F.when(F.size("original_path") > 0, F.col("original_path")).otherwise(F.col("path"))
    kind = common["type"]
    return received.select(
        "timestamp",
        *(common[c].alias(c) for c in ("header", "payload", "payload_length", "type", "route", "length")),
        "rssi",
        "snr",
        common["score"].alias("score"),
        "tx_delay_ms",
        "transmitted",
        copy.alias("is_duplicate"),
        common["packet_hash"].alias("packet_hash"),
        F.coalesce("drop_reason", F.when(copy, "Duplicate")).alias("drop_reason"),
        text.path_text(_hex_list(shown)).alias("path_hash"),
        text.source_hash(kind, F.col("payload")).alias("src_hash"),
        text.destination_hash(kind, F.col("payload")).alias("dst_hash"),
        F.when(F.size("original_path") > 0, _hex_list(F.col("original_path"))).alias("original_path"),
        _hex_list(F.col("forwarded_path")).alias("forwarded_path"),
        common["raw_packet"].alias("raw_packet"),
    )


def trace_records(received: DataFrame, spreading_factor: int = 8) -> DataFrame:
    """Records of trace packets: packet_records() with path_snrs, path_snr_details and is_trace.

    path holds the SNR bytes gathered on the way, path_length how many of them count; trace_path (bytes) the nodes of the route. Details are
    given for hops of which both are known. A trace is never sent on by the record's maker, and has no sender or destination.
    """
    common = _common(spreading_factor)
    snrs = F.slice("path", F.lit(1), F.greatest(F.lit(0), F.least(F.col("path_length"), F.size("path"))))
    decibels = lambda b: snr_from_byte(b.cast("int"))
    # To the even digit, as quarters end in ties.
    shown = F.transform(snrs, lambda b: F.format_string("%d(%.1fdB)", b.cast("int"), F.bround(decibels(b), 1)))
    nodes = F.coalesce(F.size("trace_path"), F.lit(0))
    both = F.slice(snrs, F.lit(1), F.least(F.size(snrs), nodes))
    details = F.transform(both, lambda b, i: F.struct(text.hex_byte(F.get("trace_path", i).cast("int")).alias("hash"), b.cast("int").alias("snr_raw"), decibels(b).alias("snr_db")))
    nothing = F.lit(None).cast("string")
    return received.select(
        "timestamp",
        *(common[c].alias(c) for c in ("header", "payload", "payload_length", "type", "route", "length")),
        F.coalesce("rssi", F.lit(0)).alias("rssi"),
        F.coalesce("snr", F.lit(0.0)).alias("snr"),
        F.coalesce(common["score"], F.lit(0.0)).alias("score"),
        F.lit(0.0).alias("tx_delay_ms"),
        F.lit(False).alias("transmitted"),
        F.lit(False).alias("is_duplicate"),
        common["packet_hash"].alias("packet_hash"),
        F.lit("trace_received").alias("drop_reason"),
        F.coalesce(text.path_text(_hex_list(F.col("trace_path"))), F.lit("[]")).alias("path_hash"),
        nothing.alias("src_hash"),
        nothing.alias("dst_hash"),
        _hex_list(F.col("trace_path")).alias("original_path"),
        F.lit(None).cast("array<string>").alias("forwarded_path"),
        common["raw_packet"].alias("raw_packet"),
        shown.alias("path_snrs"),
        details.alias("path_snr_details"),
        F.lit(True).alias("is_trace"),
    )
