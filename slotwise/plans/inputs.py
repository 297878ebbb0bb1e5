"""Engine-shaped inputs derived from the driver's tables.

Every frame is a plain projection of a parquet table, so a query over it grows
with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

NOW = "2024-01-29T06:00:00Z"
SECRET = "fixture-secret"
KEY_ID = "key-one"

CHAIN_EVENTS = [
    "ts AS timestamp",
    "cast(event_id AS string) AS event_id",
    "CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'transaction' ELSE 'account' END AS event_type",
    "concat('Prog', 1 + cast(get_json_object(props, '$.k') AS bigint) % 9) AS program_id",
    "unix_millis(cast(ts AS timestamp)) div 400 AS slot",
    "CASE WHEN user_id % 29 <> 0 THEN concat('sig', user_id) END AS signature",
    "props AS payload",
]

RAW_TRANSACTIONS = [
    "o_orderkey AS slot",
    "CASE WHEN o_orderkey % 11 <> 0 THEN concat('tx', o_orderkey) END AS signature",
    "o_orderstatus = 'P' AS is_vote",
    "array('program-transactions') AS filters",
    "array(concat('part', o_custkey % 250), concat('part', o_orderkey % 173), concat('acct', o_custkey))"
    " AS account_keys",
    "CASE WHEN o_orderkey % 3 = 0 THEN array(concat('part', (o_orderkey * 7) % 211)) END AS loaded_writable",
    "CASE WHEN o_orderkey % 6 = 0 THEN array(concat('part', (o_orderkey * 5) % 199)) END AS loaded_readonly",
    "5000 + o_orderkey % 5000 AS fee",
    "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 10 END AS compute_units_consumed",
    "array(concat('log ', o_orderpriority)) AS log_messages",
    "'fixture' AS source_endpoint",
    "unix_millis(cast(o_orderdate AS timestamp)) AS observed_at_unix_ms",
    "transform(sequence(0L, o_orderkey % 4), i -> named_struct("
    "'program_id_index', cast((o_custkey + i * 3) % 6 AS int), "
    "'accounts', array(cast(i AS int), cast(o_custkey % 3 AS int)), "
    "'data', encode(concat('ix', i, o_orderpriority), 'UTF-8'))) AS instructions",
]

RAW_ACCOUNTS = [
    "c_custkey AS slot",
    "concat('acct', c_custkey) AS pubkey",
    "concat('part', c_nationkey) AS owner",
    "CASE WHEN c_custkey % 3 = 0 THEN concat('tx', c_custkey) END AS signature",
    "array('program-accounts') AS filters",
    "cast(floor(abs(c_acctbal)) AS bigint) AS lamports",
    "c_custkey % 400 AS rent_epoch",
    "c_custkey * 2 AS write_version",
    "c_custkey % 2 = 0 AS executable",
    "encode(c_name, 'UTF-8') AS data",
    "'fixture' AS source_endpoint",
    "1700000000000 + c_custkey AS observed_at_unix_ms",
]

REGISTRY = [
    "concat('part', p_partkey) AS program_id",
    "CASE WHEN p_size <= 5 THEN '  ' ELSE p_name END AS name",
    "CASE p_size % 3 WHEN 0 THEN concat('{\"name\":\"', p_brand, '\",\"version\":\"0.', p_size, '\"}')"
    " WHEN 1 THEN concat('{\"version\":', p_size, '}') ELSE '{\"name\":7}' END AS content",
    "timestampadd(SECOND, cast(p_partkey * 37 % 100000 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS updated_at",
]

ROUTES = [
    "cast(n_nationkey AS bigint) AS route_id",
    "concat(' https://hook', n_nationkey % 11, '.example/in') AS url",
    "CASE WHEN n_nationkey % 4 IN (0, 1) THEN concat('Prog', 1 + n_nationkey % 9) ELSE ' ' END AS program_id",
    "CASE WHEN n_nationkey % 4 IN (0, 2) THEN element_at(array('transaction', 'account'), 1 + n_nationkey % 2)"
    " ELSE '' END AS event_type",
    "n_nationkey % 7 <> 6 AS is_active",
    "timestampadd(HOUR, cast(n_nationkey * 5 % 17 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
]

ROUTE_REQUESTS = [
    "s_suppkey AS route_id",
    "CASE s_suppkey % 9 WHEN 1 THEN 'ftp://host/in' WHEN 2 THEN 'https://' WHEN 3 THEN ''"
    " ELSE concat('https://hook', s_suppkey % 40, '.example/in ') END AS url",
    "CASE s_suppkey % 8 WHEN 5 THEN 'Prog0' WHEN 6 THEN ' ' ELSE concat('Prog', 1 + s_suppkey % 9) END AS program_id",
    "CASE s_suppkey % 7 WHEN 4 THEN 'two words' WHEN 5 THEN '' ELSE 'transaction' END AS event_type",
    "s_suppkey % 5 <> 0 AND s_suppkey % 9 <> 3 AS is_active",
    "timestampadd(HOUR, cast(s_suppkey * 5 % 1009 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
]

LAUNCHES = [
    "cast(n_nationkey AS bigint) AS launch_idx",
    "CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END AS name",
    "concat('Prog', 1 + n_nationkey % 8) AS program_id",
    "CASE WHEN n_nationkey = 24 THEN '2024-03-01T00:00:00Z'"
    " WHEN n_nationkey % 6 = 3 THEN concat('2024-01-', lpad(3 + n_nationkey, 2, '0'), 'T02:30:15.750+02:00')"
    " ELSE concat('2024-01-', lpad(3 + n_nationkey, 2, '0'), 'T', lpad(n_nationkey % 24, 2, '0'), ':00:00Z')"
    " END AS launch_at",
]

LAUNCH_REQUESTS = [
    "c_custkey AS launch_idx",
    "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE concat(' ', c_name) END AS name",
    "CASE c_custkey % 13 WHEN 4 THEN 'Prog0' WHEN 7 THEN '' ELSE concat('Prog', 1 + c_custkey % 9, ' ') END"
    " AS program_id",
    "CASE c_custkey % 11 WHEN 1 THEN 'not-a-time' WHEN 2 THEN '2024-01-05'"
    " WHEN 3 THEN concat(' 2024-01-', lpad(3 + c_custkey % 25, 2, '0'), 'T02:30:15.750+02:00')"
    " ELSE concat('2024-01-', lpad(3 + c_custkey % 25, 2, '0'), 'T', lpad(c_custkey % 24, 2, '0'), ':00:00Z')"
    " END AS launch_at",
]

_TEMPLATE = (
    "concat('SELECT ', CASE c_custkey % 3 WHEN 0 THEN 'count(*)' WHEN 1 THEN 'count_if(event_type = ''transaction'')'"
    " ELSE 'count(DISTINCT signature)' END, ' AS value FROM chain_events WHERE program_id = ''{{program_id}}'''"
    " , ' AND timestamp >= ''{{from}}'' AND timestamp < ''{{to}}''',"
    " CASE WHEN c_custkey % 43 = 0 THEN '; DROP TABLE x' ELSE '' END)"
)

MONITOR_REQUESTS = [
    "c_custkey + 1 AS monitor_id",
    "CASE WHEN c_custkey % 37 = 5 THEN ' ' ELSE c_name END AS name",
    "CASE c_custkey % 10 WHEN 9 THEN '' WHEN 8 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Prog0' ELSE 'Prog9' END"
    " ELSE concat('Prog', 1 + c_custkey % 9) END AS program_id",
    _TEMPLATE + " AS query_template",
    "element_at(array(' GT', 'gte', 'lt', 'LTE ', '', 'between'), 1 + cast(c_custkey % 6 AS int)) AS comparator",
    "(c_custkey % 50) * 1.5D AS threshold",
    "cast(c_custkey % 4 * 30 AS int) AS schedule_minutes",
    "cast(CASE WHEN c_custkey % 41 = 0 THEN 20161 ELSE 60 * (c_custkey % 48) END AS int) AS window_minutes",
    "cast(c_custkey % 5 * 15 AS int) AS cooldown_minutes",
    "cast(c_custkey % 7 * 20 AS int) AS dedupe_minutes",
    "cast(c_custkey % 13 AS int) AS retry_max_attempts",
    "cast(c_custkey % 3 * 100 AS int) AS retry_initial_backoff_ms",
    "CASE c_custkey % 23 WHEN 0 THEN 'ftp://x/y' WHEN 1 THEN ''"
    " ELSE concat('https://hook', c_custkey % 20, '.example/alert') END AS webhook_url",
    "c_custkey % 8 <> 0 AS is_active",
    "c_custkey % 11 = 0 AS dry_run",
    "timestampadd(MINUTE, cast(c_custkey * 7 % 10007 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS updated_at",
]

_OF_MONITOR = "FROM chain_events WHERE program_id = ''{{program_id}}'' AND timestamp >= ''{{from}}'' AND timestamp < ''{{to}}''"
#: Texts of many forms; the last five cannot be evaluated.
VARIED_TEXTS = [
    f"SELECT count(*) AS n {_OF_MONITOR}",
    f"SELECT max(slot) - min(slot) AS spread {_OF_MONITOR}",
    f"WITH per AS (SELECT signature, count(*) AS n {_OF_MONITOR} GROUP BY signature) SELECT max(n) AS top FROM per",
    f"SELECT round(count_if(event_type = ''transaction'') / nullif(count(*), 0), 4) AS share {_OF_MONITOR}",
    "SELECT count(DISTINCT program_id) AS programs FROM chain_events WHERE timestamp >= ''{{from}}''",
    f"SELECT event_type, count(*) AS n {_OF_MONITOR} GROUP BY event_type ORDER BY n DESC, event_type",
    f"SELECT max(event_type) AS kind {_OF_MONITOR}",
    "SELECT sum(nope) AS x FROM chain_events",
    "SELECT count(*) AS n FROM audit_log",
    "SELECT count(*) AS n FROM chain_events WHERE program_id = {{program_id}}",
    f"SELECT 1 / (count(*) - count(*)) AS r {_OF_MONITOR}",
]
VARIED_TEMPLATE = "element_at(array(" + ", ".join(f"'{t}'" for t in VARIED_TEXTS) + "), 1 + cast(c_custkey % 11 AS int))"
VARIED_REQUESTS = [VARIED_TEMPLATE + " AS query_template" if c == _TEMPLATE + " AS query_template" else c for c in MONITOR_REQUESTS]

AUDIT = [
    "event_id AS evaluation_id",
    "user_id AS monitor_id",
    "value",
    "cast(20 AS double) AS threshold",
    "'gt' AS comparator",
    "value > 20 AS triggered",
    "value > 20 AND event_type IN ('purchase', 'view') AS alert_sent",
    "CASE WHEN value <= 20 THEN 'not_triggered' WHEN event_type IN ('purchase', 'view') THEN 'sent'"
    " WHEN event_type = 'error' THEN 'failed' ELSE 'cooldown' END AS delivery_state",
    "event_type AS reason",
    "props AS query",
    "timestampadd(HOUR, -1, ts) AS window_from",
    "ts AS window_to",
    "ts AS evaluated_at",
    "false AS dry_run",
    "CASE WHEN value > 20 THEN sha2(concat(user_id, '|', cast(get_json_object(props, '$.k') AS bigint) % 3), 256) END"
    " AS dedupe_key",
    "cast(CASE WHEN value > 20 THEN 1 ELSE 0 END AS int) AS retry_attempts",
    "CASE WHEN event_type = 'error' THEN ' boom ' ELSE '' END AS error",
    "ts AS created_at",
]

REQUESTS = [
    "event_id AS request_id",
    "user_id AS key",
    "ts AS at",
    "CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'POST' ELSE 'GET' END AS method",
    "CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('/api/', event_type) END AS path",
    "cast(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS int) AS status",
    "cast(floor(value * 1000) AS bigint) AS duration_micros",
    "CASE WHEN event_id % 40 = 7 THEN '  ' WHEN event_type = 'error' THEN ' SQL.Validation '"
    " ELSE concat(upper(event_type), ' stage/', event_id % 5) END AS stage",
]

METRIC_SAMPLES = [
    "event_id AS sample_id",
    "ts",
    "concat('inst', user_id % 3) AS instance",
    "cast(event_id % 4001 AS double) AS executions",
    "cast(floor((event_id % 4001) / 18) AS double) AS errors",
]

INGEST_LOG = [
    "event_id",
    "unix_millis(cast(ts AS timestamp)) AS observed_at_unix_ms",
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'published' END AS publish_state",
    "CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'delivered' END AS delivery_state",
]

GRANTS = [
    "concat('subject', s_suppkey) AS subject",
    "CASE WHEN s_suppkey % 19 = 0 THEN ' Admin' ELSE 'viewer' END AS role",
    "CASE s_suppkey % 7 WHEN 0 THEN array('*') WHEN 1 THEN cast(array() AS array<string>)"
    " ELSE array(concat(' Prog', 1 + s_suppkey % 9), concat('Prog', 1 + s_suppkey % 5)) END AS programs",
]

QUERY_TEXTS = [
    "doc_id",
    "CASE doc_id % 9"
    " WHEN 0 THEN concat('SELECT ', text)"
    " WHEN 1 THEN concat('```sql\\n SELECT count(*) FROM chain_events WHERE payload = ''', replace(text, ';', ','),"
    " ''' FORMAT JSONEachRow\\n```;')"
    " WHEN 2 THEN text"
    " WHEN 3 THEN concat('DELETE FROM chain_events WHERE payload = ''', text, '''')"
    " WHEN 4 THEN concat('WITH x AS (SELECT 1) SELECT * FROM Chain_Events -- ', text)"
    " WHEN 5 THEN concat('select ''', replace(text, ';', ' '), ' drop'' from chain_events;')"
    " WHEN 6 THEN concat('  with t as (select 1 a) select a, ''', replace(text, ';', ''), ''' from t  format  JSON ')"
    " WHEN 7 THEN concat('```select 1;``` ')"
    " ELSE concat('select ''', replace(text, ';', ''), ''' from my_chain_events, chain_events_v2') END AS sql_text",
]

INBOUND = [
    "conv_id * 100 + turn AS request_id",
    "CASE WHEN turn % 5 = 3 THEN concat(' ', date_format(timestamp_seconds(1704067200 + conv_id * 60 + turn),"
    " \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))"
    " WHEN turn = 6 THEN 'soon' ELSE cast(1704067200 + conv_id * 60 + turn AS string) END AS sent_at",
    "CASE WHEN conv_id % 17 = 3 THEN repeat('n', 129) WHEN conv_id % 17 = 4 THEN ' '"
    " ELSE concat('n', conv_id, '-', turn div 2) END AS nonce",
    "CASE WHEN conv_id % 13 = 2 THEN 'other' WHEN conv_id % 13 = 3 THEN '' ELSE 'key-one' END AS key_id",
    "CASE WHEN conv_id % 19 = 5 THEN concat('{', role) WHEN conv_id % 19 = 6 THEN ' '"
    " ELSE to_json(named_struct('turn', turn, 'n', length(text))) END AS body",
    "concat('10.0.0.', conv_id % 250, ' ') AS source_ip",
    "timestamp_seconds(1704067200 + conv_id * 60 + turn + CASE WHEN conv_id % 23 = 7 THEN 301 ELSE turn END)"
    " AS arrived_at",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if schemas.TABLES.get(name) is not None:
        reader = reader.schema(schemas.TABLES[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


_SHAPES = {
    "chain_events": ("events", CHAIN_EVENTS),
    "raw_transactions": ("orders", RAW_TRANSACTIONS),
    "raw_accounts": ("customer", RAW_ACCOUNTS),
    "routes": ("nation", ROUTES),
    "route_requests": ("supplier", ROUTE_REQUESTS),
    "launches": ("nation", LAUNCHES),
    "launch_requests": ("customer", LAUNCH_REQUESTS),
    "monitor_requests": ("customer", MONITOR_REQUESTS),
    "varied_requests": ("customer", VARIED_REQUESTS),
    "audit": ("events", AUDIT),
    "requests": ("events", REQUESTS),
    "metric_samples": ("events", METRIC_SAMPLES),
    "ingest_log": ("events", INGEST_LOG),
    "grants": ("supplier", GRANTS),
    "query_texts": ("documents", QUERY_TEXTS),
    "inbound_unsigned": ("conversations", INBOUND),
}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine-shaped inputs above, by name."""
    source, columns = _SHAPES[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*REGISTRY)


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed requests; odd turns carry a broken signature."""
    from pyspark.sql import functions as F

    from ..functions.signing import request_signature
    from ..functions.text import strip

    rows = shape(spark, sf_dir, "inbound_unsigned")
    good = request_signature(SECRET, strip(F.col("sent_at")), strip(F.col("nonce")), F.col("body"))
    turn = F.col("request_id") % 100
    signature = (
        F.when(turn % 4 == 1, F.lit("bad"))
        .when(turn == 4, F.lit(" v1= "))
        .when(turn % 4 == 2, F.concat(F.lit("v1="), good))
        .otherwise(good)
    )
    return rows.withColumn("signature", signature)
