"""Schemas of the stored tables. Optional fields are nullable, times are epoch seconds unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str, required: str = "") -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "timestamp": T.TimestampType()}
    needed = required.split()
    return T.StructType([T.StructField(name, kinds[kind], name not in needed) for name, kind in (x.split(":") for x in spec.split())])


PACKETS = _schema(
    "id:long timestamp:double type:int route:int length:int rssi:int snr:double score:double transmitted:boolean is_duplicate:boolean drop_reason:string src_hash:string dst_hash:string "
    "path_hash:string header:string transport_codes:string payload:string payload_length:int tx_delay_ms:double packet_hash:string original_path:strings forwarded_path:strings raw_packet:string",
    "id timestamp type route length transmitted is_duplicate",
)
ADVERTS = _schema(
    "id:long timestamp:double pubkey:string node_name:string is_repeater:boolean route_type:int contact_type:string latitude:double longitude:double first_seen:double last_seen:double rssi:int "
    "snr:double advert_count:int is_new_neighbor:boolean zero_hop:boolean",
    "timestamp pubkey is_repeater first_seen last_seen advert_count is_new_neighbor zero_hop",
)
NOISE_FLOOR = _schema("id:long timestamp:double noise_floor_dbm:double", "timestamp noise_floor_dbm")
TRANSPORT_KEYS = _schema("id:long name:string flood_policy:string transport_key:string last_used:double parent_id:long created_at:double updated_at:double", "name flood_policy transport_key created_at updated_at")
SERIES = _schema("bucket_ts:long step:int cf:string ds:string value:double", "bucket_ts step cf ds")
POLICIES = ("allow", "deny")

#: Columns that reads of a table return, in order.
PACKET_COLUMNS = tuple(c for c in PACKETS.names if c != "id")
ADVERT_COLUMNS = tuple(ADVERTS.names)
KEY_COLUMNS = tuple(TRANSPORT_KEYS.names)
