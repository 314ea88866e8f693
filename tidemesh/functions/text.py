"""Packet fields as text: hexadecimal, paths, headers, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_byte(value: Column) -> Column:
    return F.format_string("%02X", value)


def header_text(value: Column) -> Column:
    return F.format_string("0x%02X", value)


def payload_type(header: Column) -> Column:
    """Bits 2 to 5."""
    return F.shiftright(header.bitwiseAND(0x3C), 2)


def path_text(path: Column, shown: int = 8) -> Column:
    """``[0A, FF, ...]``: the first hops of a list of hexadecimal bytes; null where there are none."""
    inner = F.array_join(F.slice(path, 1, shown), ", ")
    return F.when(F.size(path) > 0, F.concat(F.lit("["), inner, F.when(F.size(path) > shown, ", ...").otherwise(""), F.lit("]")))


def hash_prefix(value: Column, n: int = 16) -> Column:
    return F.upper(F.substring(value, 1, n))


def hex_bytes(value: Column) -> Column:
    """How many bytes a hexadecimal text stands for."""
    return F.floor(F.length(value) / 2).cast("int")


def source_hash(kind: Column, payload: Column) -> Column:
    """Sender's byte: the second of requests, responses, texts and paths, the first of adverts, of an upper-case hexadecimal payload."""
    byte = lambda i: F.when(F.length(payload) >= 2 * i, F.upper(F.substring(payload, 2 * i - 1, 2)))
    return F.when(kind.isin(0, 1, 2, 8), byte(2)).when(kind == 4, byte(1))


def destination_hash(kind: Column, payload: Column) -> Column:
    return F.when(kind.isin(0, 1, 2, 8) & (F.length(payload) >= 2), F.upper(F.substring(payload, 1, 2)))


def base64url(value: Column) -> Column:
    return F.translate(F.base64(value), "+/=", "-_")


def shortened_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("..."), F.substring(key, -8, 8))


def radio_text(mhz: Column, khz: Column, spreading_factor: Column, coding_rate: Column) -> Column:
    return F.concat_ws(",", mhz.cast("string"), khz.cast("string"), spreading_factor.cast("string"), coding_rate.cast("string"))


def parsed_time(value: Column) -> Column:
    """ISO 8601 with ``Z`` or an offset; null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def zero_hop(route: Column) -> Column:
    return route.isin(2, 3)


def megabytes(size: Column) -> Column:
    """Bytes in MB of 2**20, to one digit."""
    return F.round(size / 1024 / 1024, 1)


def sensor_name(chip: Column, index: Column, count: Column) -> Column:
    """A temperature's name: the chip's, with the sensor's number (from 0) where it has several."""
    return F.when(count > 1, F.concat_ws("_", chip, index.cast("string"))).otherwise(chip)
