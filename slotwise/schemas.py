"""Explicit schemas; nothing in this package infers one."""

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<int>": T.ArrayType(T.IntegerType()),
}


def _struct(columns: str) -> T.StructType:
    """'name type, ...' as a schema, usable before a session exists."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENT_LOG = _struct(
    "timestamp timestamp_ntz, event_id string, event_type string, program_id string, "
    "slot bigint, signature string, payload string"
)

NORMALIZED_EVENT = _struct(
    "event_id string, event_type string, program_id string, slot bigint, signature string, "
    "partition_key string, source_endpoint string, observed_at_unix_ms bigint, payload string"
)

INSTRUCTION = _struct("program_id_index int, accounts array<int>, data binary")

RAW_TRANSACTION = T.StructType(
    _struct(
        "slot bigint, signature string, is_vote boolean, filters array<string>, account_keys array<string>, "
        "loaded_writable array<string>, loaded_readonly array<string>, fee bigint, "
        "compute_units_consumed bigint, log_messages array<string>, source_endpoint string, "
        "observed_at_unix_ms bigint"
    ).fields
    + [T.StructField("instructions", T.ArrayType(INSTRUCTION))]
)

RAW_ACCOUNT = _struct(
    "slot bigint, pubkey string, owner string, signature string, filters array<string>, lamports bigint, "
    "rent_epoch bigint, write_version bigint, executable boolean, data binary, source_endpoint string, "
    "observed_at_unix_ms bigint"
)

REGISTRY = _struct("program_id string, name string, content string, updated_at timestamp_ntz")

ROUTES = _struct(
    "route_id bigint, url string, program_id string, event_type string, is_active boolean, created_at timestamp_ntz"
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("failed_at_unix_ms", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("event", NORMALIZED_EVENT),
    ]
)

AUDIT = _struct(
    "evaluation_id bigint, monitor_id bigint, value double, threshold double, comparator string, "
    "triggered boolean, alert_sent boolean, delivery_state string, reason string, query string, "
    "window_from timestamp_ntz, window_to timestamp_ntz, evaluated_at timestamp_ntz, dry_run boolean, "
    "dedupe_key string, retry_attempts int, error string, created_at timestamp_ntz"
)

INBOUND_REQUEST = _struct(
    "request_id bigint, sent_at string, nonce string, signature string, key_id string, body string, "
    "source_ip string, arrived_at timestamp"
)

# The driver's tables, for the fixtures only.
TABLES = {
    "events": _struct(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "orders": _struct(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": _struct(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": _struct(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "supplier": _struct("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "nation": None,
    "documents": _struct("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "pages": _struct("page_id bigint, url string, html string"),
    "conversations": _struct("conv_id bigint, turn bigint, role string, text string"),
}
