"""Independent DuckDB SQL for the registered queries."""

from __future__ import annotations

from .inputs import SECRET, VARIED_TEXTS

_WS = "concat(chr(9),chr(10),chr(11),chr(12),chr(13),' ',chr(133),chr(160),chr(5760)," + ",".join(
    f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
) + ")"
# Written out here, not taken from the engine: key pads of HMAC-SHA256 and the unsafe words.
_INNER, _OUTER = (bytes(b ^ pad for b in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_UNSAFE = "insert|update|delete|drop|alter|truncate|optimize|system|create|attach|detach|grant|revoke|kill|rename"


def _strip(c: str) -> str:
    return f"trim({c}, {_WS})"


def _base58(c: str) -> str:
    return f"regexp_full_match({c}, '[1-9A-HJ-NP-Za-km-z]+')"


def _hmac(sent: str, nonce: str, body: str) -> str:
    message = f"encode({sent} || chr(10) || {nonce} || chr(10) || {body})"
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || {message})))"


def _rfc(c: str) -> str:
    shape = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})"
    return (
        f"CASE WHEN regexp_full_match({_strip(c)}, '{shape}') "
        f"THEN epoch_us(try_cast({_strip(c)} AS TIMESTAMPTZ)) END"
    )


def _text_time(us: str) -> str:
    return f"strftime(make_timestamp(CAST({us} AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"


_URL = (
    r"(?i)https?://([^/?#@\s]*@)?((\[[0-9a-f:.]+\]|[^/?#@\s:\[\]<>\"%\\^`{|}]+)(:[0-9]*)?|:[0-9]*)([/?#].*)?"
)


def _url(c: str) -> str:
    path = f"regexp_extract({_strip(c)}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    return (
        f"(regexp_full_match({_strip(c)}, '{_URL}') AND NOT regexp_matches({_strip(c)}, '[\\x00-\\x1f\\x7f]') "
        f"AND NOT contains(regexp_replace({path}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%'))"
    )


_NOW_US = "epoch_us(TIMESTAMP '2024-01-29 06:00:00')"

_CTE: dict[str, tuple[str, ...]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    _CTE[name] = (sql, *needs)


def _with(*names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTE[n][1:]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({_CTE[n][0]})" for n in order) + " "


_cte(
    "chain_events",
    """SELECT ts AS timestamp, CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN event_type = 'view' OR event_type = 'error' THEN 'account' ELSE 'transaction' END AS event_type,
    'Prog' || (1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 9) AS program_id,
    epoch_us(ts) // 400000 AS slot, CASE WHEN user_id % 29 = 0 THEN NULL ELSE 'sig' || user_id END AS signature,
    props AS payload FROM events""",
)
_cte(
    "raw_tx",
    """SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'tx' || o_orderkey END AS signature,
    o_orderstatus = 'P' AS is_vote, ['program-transactions'] AS filters,
    ['part' || (o_custkey % 250), 'part' || (o_orderkey % 173), 'acct' || o_custkey] AS own_keys,
    CASE WHEN o_orderkey % 3 = 0 THEN ['part' || ((o_orderkey * 7) % 211)] ELSE [] END AS lw,
    CASE WHEN o_orderkey % 6 = 0 THEN ['part' || ((o_orderkey * 5) % 199)] ELSE [] END AS lr,
    5000 + o_orderkey % 5000 AS fee, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 10 END AS cu,
    ['log ' || o_orderpriority] AS logs, (epoch_us(o_orderdate) // 1000) AS observed, o_custkey, o_orderpriority FROM orders""",
)
_cte(
    "steps",
    """SELECT *, list_concat(own_keys, lw, lr) AS keys, CAST((o_custkey + i * 3) % 6 AS INTEGER) AS pidx
    FROM (SELECT *, unnest(range(0, slot % 4 + 1)) AS i FROM raw_tx)""",
    "raw_tx",
)
_cte(
    "raw_acc",
    """SELECT c_custkey AS slot, 'acct' || c_custkey AS pubkey, 'part' || c_nationkey AS owner,
    CASE WHEN c_custkey % 3 = 0 THEN 'tx' || c_custkey END AS signature, ['program-accounts'] AS filters,
    CAST(floor(abs(c_acctbal)) AS BIGINT) AS lamports, c_custkey % 400 AS rent_epoch, c_custkey * 2 AS write_version,
    c_custkey % 2 = 0 AS executable, c_name AS data, 1700000000000 + c_custkey AS observed FROM customer""",
)
_cte(
    "registry_rows",
    """SELECT 'part' || p_partkey AS program_id, CASE WHEN p_size <= 5 THEN '  ' ELSE p_name END AS name,
    CASE p_size % 3 WHEN 0 THEN '{"name":"' || p_brand || '","version":"0.' || p_size || '"}'
    WHEN 1 THEN '{"version":' || p_size || '}' ELSE '{"name":7}' END AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey * 37 % 100000) AS updated_at
    FROM part""",
)
_cte(
    "registry",
    """SELECT program_id, CASE WHEN trim(name) <> '' THEN name
    WHEN json_type(content, '$.name') = 'VARCHAR' THEN json_extract_string(content, '$.name')
    ELSE 'unknown' END AS idl_name, json_extract(content, '$.version') AS idl_version FROM registry_rows""",
    "registry_rows",
)
_cte(
    "tx_events",
    """SELECT coalesce(signature, 'unknown-signature') || ':' || slot || ':' || i AS event_id,
    'transaction' AS event_type, r.program_id, slot, signature, coalesce(signature, r.program_id) AS partition_key,
    'fixture' AS source_endpoint, observed AS observed_at_unix_ms,
    CAST(to_json({'account_keys': keys, 'filters': filters, 'idl_name': idl_name, 'idl_version': idl_version,
     'instruction': {'accounts': [CAST(i AS INTEGER), CAST(o_custkey % 3 AS INTEGER)],
       'data_base64': base64(encode('ix' || i || o_orderpriority)), 'program_id_index': pidx},
     'instruction_index': CAST(i AS INTEGER), 'is_vote': is_vote,
     'meta': {'compute_units_consumed': cu, 'fee': fee, 'log_messages': logs}}) AS VARCHAR) AS payload
    FROM steps s JOIN registry r ON r.program_id = s.keys[s.pidx + 1]""",
    "steps",
    "registry",
)
_cte(
    "acc_events",
    """SELECT slot || ':' || pubkey || ':account' AS event_id, 'account' AS event_type, owner AS program_id, slot,
    signature, coalesce(signature, pubkey) AS partition_key, 'fixture' AS source_endpoint,
    observed AS observed_at_unix_ms,
    CAST(to_json({'account_pubkey': pubkey, 'data_base64': base64(encode(data)), 'executable': executable,
     'filters': filters, 'idl_name': idl_name, 'idl_version': idl_version, 'lamports': lamports, 'owner': owner,
     'rent_epoch': rent_epoch, 'write_version': write_version}) AS VARCHAR) AS payload
    FROM raw_acc JOIN registry ON program_id = owner""",
    "raw_acc",
    "registry",
)
_cte(
    "routes",
    """SELECT n_nationkey AS route_id, 'https://hook' || (n_nationkey % 11) || '.example/in' AS url,
    CASE WHEN n_nationkey % 4 < 2 THEN 'Prog' || (1 + n_nationkey % 9) END AS program_id,
    CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 4 = 2 THEN
      CASE WHEN n_nationkey % 2 = 0 THEN 'transaction' ELSE 'account' END END AS event_type
    FROM nation WHERE n_nationkey % 7 <> 6""",
)
_cte(
    "matched",
    """SELECT e.event_id, CAST(r.route_id AS VARCHAR) AS route_id, r.route_id AS ord, r.url,
    coalesce(r.program_id, '*') AS program_id_filter, coalesce(r.event_type, '*') AS event_type_filter,
    'registry' AS source FROM chain_events e JOIN routes r
    ON (r.program_id IS NULL OR r.program_id = e.program_id) AND (r.event_type IS NULL OR r.event_type = e.event_type)""",
    "chain_events",
    "routes",
)
_cte(
    "matched_static",
    """SELECT event_id, route_id, ord, url, source FROM matched UNION ALL
    SELECT event_id, 'static-env', 1000000, 'https://hook3.example/in', 'env' FROM chain_events""",
    "matched",
)
_cte(
    "route_requests",
    """SELECT s_suppkey AS route_id, CASE s_suppkey % 9 WHEN 1 THEN 'ftp://host/in' WHEN 2 THEN 'https://' WHEN 3 THEN ''
    ELSE 'https://hook' || (s_suppkey % 40) || '.example/in ' END AS url,
    CASE s_suppkey % 8 WHEN 5 THEN 'Prog0' WHEN 6 THEN ' ' ELSE 'Prog' || (1 + s_suppkey % 9) END AS program_id,
    CASE s_suppkey % 7 WHEN 4 THEN 'two words' WHEN 5 THEN '' ELSE 'transaction' END AS event_type,
    s_suppkey % 5 <> 0 AND s_suppkey % 9 <> 3 AS is_active,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey * 5 % 1009) AS created_at FROM supplier""",
)
_cte(
    "launches",
    """SELECT n_nationkey AS launch_idx, program_id, CASE WHEN n_nationkey % 5 = 0 THEN program_id ELSE n_name END AS name,
    (launch_us // 1000000) * 1000000 AS at_us, ((launch_us // 1000000) - 86400) * 1000000 AS start_us,
    ((launch_us // 1000000) + 21600) * 1000000 AS end_us
    FROM (SELECT n_nationkey, n_name, 'Prog' || (1 + n_nationkey % 8) AS program_id,
      CASE WHEN n_nationkey = 24 THEN epoch_us(TIMESTAMP '2024-03-01')
      WHEN n_nationkey % 6 = 3 THEN epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(2 + n_nationkey AS INTEGER))
        + INTERVAL '15.750' SECOND + INTERVAL 30 MINUTE)
      ELSE epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(2 + n_nationkey AS INTEGER)) + to_hours(n_nationkey % 24)) END AS launch_us
      FROM nation)""",
)
_WINDOW_COUNTS = """count(t) FILTER (t < at_us) AS baseline_events,
    count(DISTINCT sig) FILTER (t < at_us) AS baseline_unique_signatures,
    count(t) FILTER (t < at_us AND kind = 'transaction') AS baseline_transactions,
    count(t) FILTER (t >= at_us) AS evaluation_events,
    count(DISTINCT sig) FILTER (t >= at_us) AS evaluation_unique_signatures,
    count(t) FILTER (t >= at_us AND kind = 'transaction') AS evaluation_transactions"""
_FLAT = """(SELECT program_id AS p, epoch_us(timestamp) AS t, coalesce(signature, '') AS sig, event_type AS kind
    FROM chain_events)"""
_cte(
    "metrics",
    f"""SELECT launch_idx, program_id, name, at_us, start_us, end_us, {_WINDOW_COUNTS}
    FROM launches LEFT JOIN {_FLAT} ON p = program_id AND t >= start_us AND t < end_us GROUP BY ALL""",
    "launches",
    "chain_events",
)


def _ratio(b: str, e: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({e} AS DOUBLE) / {b} WHEN {e} > 0 THEN CAST({e} AS DOUBLE) ELSE 1.0::DOUBLE END"


_RATIOS = f"""{_ratio('baseline_events', 'evaluation_events')} AS r1,
    {_ratio('baseline_unique_signatures', 'evaluation_unique_signatures')} AS r2,
    {_ratio('baseline_transactions', 'evaluation_transactions')} AS r3"""
_cte(
    "judged",
    f"""SELECT *, CASE WHEN score >= 2.0 AND evaluation_events >= 5 THEN 'worked' ELSE 'not_worked' END AS outcome
    FROM (SELECT *, r1 >= 0.25 AS s1, r2 >= 0.30 AS s2, r3 >= 0.25 AS s3,
      CAST((r1 >= 0.25)::INT + (r2 >= 0.30)::INT + (r3 >= 0.25)::INT AS DOUBLE)
      + CASE WHEN evaluation_events >= 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
      FROM (SELECT *, {_RATIOS} FROM metrics))""",
    "metrics",
)
_SIGNAL_ROWS = """(SELECT launch_idx, outcome, 'event_growth' AS signal, s1 AS hit FROM {0}
    UNION ALL SELECT launch_idx, outcome, 'unique_signer_growth', s2 FROM {0}
    UNION ALL SELECT launch_idx, outcome, 'transaction_growth', s3 FROM {0})"""


def _performance(rows: str) -> str:
    return f"""SELECT signal,
    CASE WHEN count(*) FILTER (hit) > 0 THEN CAST(count(*) FILTER (hit AND outcome = 'worked') AS DOUBLE) / count(*) FILTER (hit)
      ELSE CAST(count(*) FILTER (outcome = 'worked') AS DOUBLE) / count(*) END AS precision,
    CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS coverage,
    count(*) FILTER (hit AND outcome = 'worked') AS worked_with_signal, count(*) FILTER (hit) AS total_with_signal
    FROM {rows} GROUP BY signal"""


_cte("past", "SELECT * FROM judged WHERE launch_idx < 16", "judged")
_cte("future", "SELECT * FROM judged WHERE launch_idx >= 16", "judged")
_cte("perf", _performance(_SIGNAL_ROWS.format("past")), "past")
_cte(
    "prior",
    "SELECT CAST(count(*) FILTER (outcome = 'worked') AS DOUBLE) / count(*) AS prior, count(*) AS n FROM past",
    "past",
)
_cte(
    "contributions",
    f"""SELECT f.launch_idx, f.signal, f.hit, precision, coverage, worked_with_signal, total_with_signal, prior,
    CASE WHEN f.hit THEN (precision - prior) * (0.6::DOUBLE + 0.4::DOUBLE * coverage)
      ELSE -(precision - prior) * 0.25::DOUBLE * coverage END + 0.0::DOUBLE AS contribution
    FROM {_SIGNAL_ROWS.format('future')} f JOIN perf USING (signal), prior""",
    "future",
    "perf",
    "prior",
)
_cte(
    "launch_requests",
    f"""SELECT launch_idx, CASE WHEN {_strip('n')} = '' THEN {_strip('p')} ELSE {_strip('n')} END AS name,
    {_strip('p')} AS program_id, p AS raw_program, a AS launch_at, {_rfc('a')} AS at_us
    FROM (SELECT c_custkey AS launch_idx, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' ' || c_name END AS n,
      CASE c_custkey % 13 WHEN 4 THEN 'Prog0' WHEN 7 THEN '' ELSE 'Prog' || (1 + c_custkey % 9) || ' ' END AS p,
      CASE c_custkey % 11 WHEN 1 THEN 'not-a-time' WHEN 2 THEN '2024-01-05'
      WHEN 3 THEN ' 2024-01-' || lpad(CAST(3 + c_custkey % 25 AS VARCHAR), 2, '0') || 'T02:30:15.750+02:00'
      ELSE '2024-01-' || lpad(CAST(3 + c_custkey % 25 AS VARCHAR), 2, '0') || 'T'
        || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':00:00Z' END AS a FROM customer)""",
)
_cte(
    "checked_launches",
    f"""SELECT *, CASE WHEN program_id = '' THEN 'each launch requires program_id'
    WHEN NOT {_base58('program_id')} THEN 'program_id must be base58'
    WHEN at_us IS NULL THEN 'launch_at must be RFC3339 timestamp' END AS reject_reason FROM launch_requests""",
    "launch_requests",
)
_cte(
    "monitor_requests",
    """SELECT c_custkey AS c, c_custkey + 1 AS monitor_id, CASE WHEN c_custkey % 37 = 5 THEN '' ELSE c_name END AS name,
    CASE c_custkey % 10 WHEN 9 THEN '' WHEN 8 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Prog0' ELSE 'Prog9' END
      ELSE 'Prog' || (1 + c_custkey % 9) END AS program_id,
    CASE c_custkey % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'transactions' ELSE 'unique_signatures' END AS metric,
    'SELECT ' || CASE c_custkey % 3 WHEN 0 THEN 'count(*)' WHEN 1 THEN 'count_if(event_type = ''transaction'')'
      ELSE 'count(DISTINCT signature)' END || ' AS value FROM chain_events WHERE program_id = ''{{program_id}}'''
      || ' AND timestamp >= ''{{from}}'' AND timestamp < ''{{to}}'''
      || CASE WHEN c_custkey % 43 = 0 THEN '; DROP TABLE x' ELSE '' END AS query_template,
    CASE c_custkey % 6 WHEN 0 THEN 'gt' WHEN 1 THEN 'gte' WHEN 2 THEN 'lt' WHEN 3 THEN 'lte' WHEN 4 THEN 'lt'
      ELSE 'between' END AS comparator,
    (c_custkey % 50) * 1.5::DOUBLE AS threshold,
    CASE WHEN c_custkey % 4 = 0 THEN 60 ELSE c_custkey % 4 * 30 END AS schedule_minutes,
    CASE WHEN c_custkey % 41 = 0 THEN 20161 WHEN c_custkey % 48 = 0 THEN 60 ELSE 60 * (c_custkey % 48) END AS window_minutes,
    CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE c_custkey % 5 * 15 END AS cooldown_minutes,
    CASE WHEN c_custkey % 7 = 0 THEN 15 ELSE c_custkey % 7 * 20 END AS dedupe_minutes,
    CASE WHEN c_custkey % 13 = 0 THEN 3 ELSE c_custkey % 13 END AS retry_max_attempts,
    CASE WHEN c_custkey % 3 = 0 THEN 200 ELSE c_custkey % 3 * 100 END AS retry_initial_backoff_ms,
    CASE c_custkey % 23 WHEN 0 THEN 'ftp://x/y' WHEN 1 THEN '' ELSE 'https://hook' || (c_custkey % 20) || '.example/alert'
      END AS webhook_url, c_custkey % 8 <> 0 AS is_active, c_custkey % 11 = 0 AS dry_run,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey * 7 % 10007) AS updated_at FROM customer""",
)
_MONITOR_REASON = f"""CASE WHEN name = '' THEN 'name is required'
    WHEN comparator NOT IN ('gt', 'gte', 'lt', 'lte') THEN 'comparator must be one of: gt, gte, lt, lte'
    WHEN program_id <> '' AND NOT {_base58('program_id')} THEN 'program_id must be base58'
    WHEN webhook_url = '' THEN 'webhook_url is required'
    WHEN webhook_url LIKE 'ftp%' THEN 'webhook_url is invalid'
    WHEN window_minutes > 20160 THEN 'window_minutes cannot exceed 20160'
    WHEN dedupe_minutes > 20160 THEN 'dedupe_minutes cannot exceed 20160'
    WHEN retry_max_attempts > 10 THEN 'retry_max_attempts cannot exceed 10'
    WHEN retry_initial_backoff_ms > 30000 THEN 'retry_initial_backoff_ms cannot exceed 30000'
    WHEN contains(query_template, ';') THEN 'query_template is invalid: multiple statements are not allowed' END"""
_cte("checked_monitors", f"SELECT *, {_MONITOR_REASON} AS reject_reason FROM monitor_requests", "monitor_requests")
_cte("monitors", "SELECT * EXCLUDE (reject_reason) FROM checked_monitors WHERE reject_reason IS NULL", "checked_monitors")
_cte(
    "audit",
    """SELECT event_id AS evaluation_id, user_id AS monitor_id, value, 20.0::DOUBLE AS threshold, 'gt' AS comparator,
    value > 20 AS triggered, value > 20 AND event_type IN ('purchase', 'view') AS alert_sent,
    CASE WHEN value <= 20 THEN 'not_triggered' WHEN event_type IN ('purchase', 'view') THEN 'sent'
      WHEN event_type = 'error' THEN 'failed' ELSE 'cooldown' END AS delivery_state, event_type AS reason,
    props AS query, ts AS evaluated_at, epoch_us(ts) AS at_us,
    CASE WHEN value > 20 THEN sha256(user_id || '|' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3)) END AS dedupe_key
    FROM events""",
)
_cte(
    "values_now",
    f"""SELECT m.*, CAST(CASE m.metric WHEN 'events' THEN n WHEN 'transactions' THEN nt ELSE ns END AS DOUBLE) AS value
    FROM monitors m JOIN (SELECT monitor_id, count(t) AS n, count(t) FILTER (kind = 'transaction') AS nt,
      count(DISTINCT sig) AS ns FROM monitors q LEFT JOIN {_FLAT}
      ON p = q.program_id AND t >= {_NOW_US} - q.window_minutes::BIGINT * 60000000 AND t < {_NOW_US} GROUP BY monitor_id)
    USING (monitor_id)""",
    "monitors",
    "chain_events",
)


def _last(name: str, where: str = "true") -> None:
    _cte(
        name,
        f"""SELECT monitor_id, max(at_us) AS last_us, arg_max(value, (at_us, evaluation_id)) AS last_value,
        max(at_us) FILTER (alert_sent) AS sent_us,
        arg_max(dedupe_key, (at_us, evaluation_id)) FILTER (alert_sent) AS last_fingerprint
        FROM audit WHERE {where} GROUP BY monitor_id""",
        "audit",
    )


_last("last_all")
_last("last_now", f"at_us < {_NOW_US}")


def _evaluated(name: str, values: str, last: str, now: str) -> None:
    _cte(
        name,
        f"""SELECT *, CASE WHEN value IS NULL THEN 'evaluation_failed' WHEN NOT triggered THEN 'not_triggered' WHEN dry_run THEN 'dry_run'
      WHEN sent_us IS NOT NULL AND {now} - sent_us < cooldown_minutes::BIGINT * 60000000 THEN 'cooldown'
      WHEN sent_us IS NOT NULL AND last_fingerprint = dedupe_key AND {now} - sent_us < dedupe_minutes::BIGINT * 60000000
        THEN 'deduped' ELSE 'queued' END AS delivery_state
    FROM (SELECT *, CASE WHEN triggered THEN sha256(printf('%d|%s|%s|%s|%.6f|%.6f', monitor_id, program_id, comparator,
      query_template, threshold, value)) END AS dedupe_key,
      {_text_time(f"{now} - window_minutes::BIGINT * 60000000")} AS from_text
      FROM (SELECT v.*, last_us, sent_us, last_fingerprint, CASE comparator WHEN 'gt' THEN v.value > threshold
        WHEN 'gte' THEN v.value >= threshold WHEN 'lt' THEN v.value < threshold ELSE v.value <= threshold END AS triggered
        FROM {values} v LEFT JOIN {last} USING (monitor_id)))""",
        values,
        last,
    )


_evaluated("evaluated", "values_now", "last_now", _NOW_US)
_RENDERED = """replace(replace(replace(query_template, '{{program_id}}', program_id), '{{from}}', from_text), '{{to}}',
    '2024-01-29T06:00:00Z')"""
_cte(
    "texts",
    r"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'SELECT ' || text
    WHEN 1 THEN '```sql' || chr(10) || ' SELECT count(*) FROM chain_events WHERE payload = ''' || replace(text, ';', ',')
      || ''' FORMAT JSONEachRow' || chr(10) || '```;'
    WHEN 2 THEN text WHEN 3 THEN 'DELETE FROM chain_events WHERE payload = ''' || text || ''''
    WHEN 4 THEN 'WITH x AS (SELECT 1) SELECT * FROM Chain_Events -- ' || text
    WHEN 5 THEN 'select ''' || replace(text, ';', ' ') || ' drop'' from chain_events;'
    WHEN 6 THEN '  with t as (select 1 a) select a, ''' || replace(text, ';', '') || ''' from t  format  JSON '
    WHEN 7 THEN '```select 1;``` '
    ELSE 'select ''' || replace(text, ';', '') || ''' from my_chain_events, chain_events_v2' END AS q FROM documents""",
)
_cte(
    "cleaned",
    f"""SELECT doc_id, {_strip("regexp_replace(c4, '(?i)[[:space:]]+format[[:space:]]+[a-z_0-9]+[[:space:]]*$', '')")} AS c FROM (
    SELECT doc_id, {_strip("CASE WHEN c3 LIKE '%```' THEN c3[:-4] ELSE c3 END")} AS c4 FROM (
    SELECT doc_id, CASE WHEN c2 LIKE '```%' THEN {_strip("substr(c2, 4)")} ELSE c2 END AS c3 FROM (
    SELECT doc_id, CASE WHEN c1 LIKE '```sql%' THEN {_strip("substr(c1, 7)")} ELSE c1 END AS c2 FROM (
    SELECT doc_id, {_strip("CASE WHEN c0 LIKE '%;' THEN c0[:-2] ELSE c0 END")} AS c1 FROM (
    SELECT doc_id, {_strip('q')} AS c0 FROM texts)))))""",
    "texts",
)
_cte(
    "samples",
    """SELECT event_id AS sample_id, epoch_us(ts) AS at_us, 'inst' || (user_id % 3) AS instance,
    CAST(event_id % 4001 AS DOUBLE) AS executions, CAST((event_id % 4001) // 18 AS DOUBLE) AS errors FROM events""",
)
_cte(
    "deltas",
    """SELECT *, CASE WHEN pe IS NULL THEN 0 WHEN executions < pe THEN executions ELSE executions - pe END AS de,
    CASE WHEN pr IS NULL THEN 0 WHEN errors < pr THEN errors ELSE errors - pr END AS dr
    FROM (SELECT *, lag(executions) OVER w AS pe, lag(errors) OVER w AS pr FROM samples
      WINDOW w AS (PARTITION BY instance ORDER BY at_us, sample_id))""",
    "samples",
)
_cte(
    "grid",
    """SELECT step, sum(coalesce(dr, 0)) OVER f AS errors_increase, sum(coalesce(de, 0)) OVER f AS executions_increase
    FROM (SELECT unnest(range(lo, hi + 1)) AS step FROM (SELECT min(s) AS lo, max(s) AS hi
      FROM (SELECT (at_us + 29999999) // 30000000 AS s FROM deltas))) g
    LEFT JOIN (SELECT (at_us + 29999999) // 30000000 AS step, sum(de) AS de, sum(dr) AS dr FROM deltas GROUP BY 1) USING (step)
    WINDOW f AS (ORDER BY step ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW)""",
    "deltas",
)
_cte(
    "rates",
    """SELECT *, errors_increase / greatest(executions_increase, 1) AS ratio,
    errors_increase / greatest(executions_increase, 1) > 0.05 AS breached FROM grid""",
    "grid",
)
_cte(
    "inbound",
    f"""SELECT *, CASE WHEN turn % 4 = 1 THEN 'bad' WHEN turn = 4 THEN '' WHEN turn % 4 = 2 THEN good ELSE good END AS given,
    CASE WHEN regexp_full_match({_strip('sent_at')}, '[+-]?[0-9]+') THEN CAST({_strip('sent_at')} AS BIGINT) * 1000000
      ELSE {_rfc('sent_at')} END AS received_us
    FROM (SELECT *, {_hmac(_strip('sent_at'), _strip('nonce'), 'body')} AS good FROM (
    SELECT conv_id * 100 + turn AS request_id, conv_id, turn,
    CASE WHEN turn % 5 = 3 THEN ' ' || strftime(make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
      WHEN turn = 6 THEN 'soon' ELSE CAST(1704067200 + conv_id * 60 + turn AS VARCHAR) END AS sent_at,
    CASE WHEN conv_id % 17 = 3 THEN repeat('n', 129) WHEN conv_id % 17 = 4 THEN ' ' ELSE 'n' || conv_id || '-' || (turn // 2) END AS nonce,
    CASE WHEN conv_id % 13 = 2 THEN 'other' WHEN conv_id % 13 = 3 THEN '' ELSE 'key-one' END AS key_id,
    CASE WHEN conv_id % 19 = 5 THEN '{{' || role WHEN conv_id % 19 = 6 THEN ' '
      ELSE '{{"turn":' || turn || ',"n":' || length(text) || '}}' END AS body,
    '10.0.0.' || (conv_id % 250) AS source_ip,
    (1704067200 + conv_id * 60 + turn + CASE WHEN conv_id % 23 = 7 THEN 301 ELSE turn END) * 1000000 AS arrived_us
    FROM conversations))""",
)
_cte(
    "verified",
    f"""SELECT *, CASE WHEN {_strip('body')} = '' THEN 'payload is required' WHEN NOT json_valid(body) THEN 'payload must be valid JSON'
    WHEN received_us IS NULL THEN 'timestamp must be unix seconds or RFC3339'
    WHEN abs(arrived_us - received_us) > 300000000 THEN 'timestamp outside allowed tolerance'
    WHEN {_strip('nonce')} = '' THEN 'nonce is required' WHEN strlen({_strip('nonce')}) > 128 THEN 'nonce exceeds maximum length'
    WHEN given = '' THEN 'signature is required' WHEN given <> good THEN 'invalid signature'
    WHEN key_id NOT IN ('', 'key-one') THEN 'key id mismatch' END AS reject_reason FROM inbound""",
    "inbound",
)


def _chain(rows: str, quiet: str, repeat: str = "0", needs: tuple[str, ...] = ()) -> str:
    """Row-by-row recursion: key k, time t, tie i, mark m; state is (anchor, mark, count)."""
    _cte("numbered", f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, i) AS rn FROM ({rows})", *needs)
    fresh = f"(n.t - c.anchor >= {quiet} AND NOT (n.m <> '' AND n.m = c.mark AND n.t - c.anchor < {repeat}))"
    _cte(
        "chain",
        f"""SELECT k, i, t, rn, true AS accepted, t AS anchor, m AS mark, 1::BIGINT AS pos FROM numbered WHERE rn = 1
        UNION ALL SELECT n.k, n.i, n.t, n.rn, {fresh}, CASE WHEN {fresh} THEN n.t ELSE c.anchor END,
        CASE WHEN {fresh} THEN n.m ELSE c.mark END, CASE WHEN {fresh} THEN 1 ELSE c.pos + 1 END
        FROM chain c JOIN numbered n ON n.k = c.k AND n.rn = c.rn + 1""",
        "numbered",
    )
    return _with("chain", recursive=True)


ORACLE: dict[str, str] = {}
_O = ORACLE
_O["scan_events"] = _with("chain_events") + (
    "SELECT epoch_us(timestamp) AS timestamp_us, event_id, event_type, program_id, slot, signature, payload FROM chain_events"
)
_O["read_json_rows"] = _O["scan_events"]
_O["subscription_filter"] = _with("raw_tx", "raw_acc") + """, subs AS (SELECT 'part' || r AS id FROM range(0, 250, 3) t(r))
SELECT 'transaction' AS kind, slot, own_keys[1] AS subject FROM raw_tx WHERE NOT is_vote
AND (own_keys[1] IN (SELECT id FROM subs) OR own_keys[2] IN (SELECT id FROM subs) OR own_keys[3] IN (SELECT id FROM subs))
UNION ALL SELECT 'account', slot, pubkey FROM raw_acc WHERE owner IN (SELECT id FROM subs)"""
_O["load_registry"] = _with("registry") + "SELECT program_id, idl_name, CAST(idl_version AS VARCHAR) AS idl_version FROM registry"
_O["load_active_routes"] = _with("route_requests") + """SELECT route_id, trim(url) AS url, nullif(trim(program_id), '') AS program_id,
nullif(trim(event_type), '') AS event_type FROM route_requests WHERE is_active"""
_O["export_json_rows"] = _with("chain_events") + """SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type,
'program_id': program_id, 'slot': slot, 'signature': signature}) AS VARCHAR) AS row FROM chain_events"""
_cte(
    "letters",
    """SELECT CASE WHEN slot % 97 = 1 THEN NULL ELSE event_id END AS event_id, slot, CASE WHEN slot % 97 = 1 THEN NULL
    ELSE observed_at_unix_ms + 5 END AS failed_at, CASE WHEN slot % 97 = 1 THEN '{broken ' || slot END AS bad_line
    FROM acc_events""",
    "acc_events",
)
_cte(
    "batch",
    "SELECT * FROM letters ORDER BY failed_at NULLS FIRST, bad_line LIMIT 200",
    "letters",
)
_O["read_dlq"] = _with("letters") + """SELECT event_id, failed_at AS failed_at_unix_ms,
CASE WHEN bad_line IS NULL THEN 'publish failed' END AS error, bad_line FROM letters"""
_O["replay_batch"] = _with("batch") + "SELECT event_id, bad_line FROM batch"
_DONE = "bad_line IS NULL AND slot % 10 <> 1"
_O["dlq_remaining"] = _with("batch") + f"""SELECT event_id, bad_line FROM letters WHERE slot NOT IN
(SELECT slot FROM batch WHERE {_DONE})"""
_O["dlq_backlog"] = _with("batch") + f"""SELECT processed, replayed, total - replayed AS remaining, total - replayed >= 200 AS alert
FROM (SELECT (SELECT count(*) FROM batch) AS processed, (SELECT count(*) FROM batch WHERE {_DONE}) AS replayed,
(SELECT count(*) FROM letters) AS total)"""
_O["write_dlq"] = _with("tx_events") + """SELECT 1706508000000 AS failed_at_unix_ms, 'topic unavailable' AS error, event_id,
program_id, partition_key FROM tx_events"""
_O["publish_events"] = _with("tx_events") + """SELECT partition_key AS key, CAST(to_json({'event_id': event_id,
'event_type': event_type, 'program_id': program_id, 'slot': slot, 'signature': signature, 'partition_key': partition_key,
'source_endpoint': source_endpoint, 'observed_at_unix_ms': observed_at_unix_ms, 'payload': payload}) AS VARCHAR) AS value
FROM tx_events"""
_O["append_audit"] = _with("evaluated") + f"""SELECT monitor_id, value, triggered, false AS alert_sent, delivery_state,
{_NOW_US} AS evaluated_at_us, {_NOW_US} - window_minutes::BIGINT * 60000000 AS window_from_us FROM evaluated"""
_O["channel_topics"] = _with("chain_events") + """SELECT 'live:' || program_id || ':' || event_type AS channel, event_id FROM chain_events
UNION ALL SELECT 'live:' || program_id || ':all', event_id FROM chain_events"""
_O["event_log_days"] = _with("chain_events") + """SELECT program_id, event_type, count(*) AS events, max(slot) AS last_slot
FROM chain_events WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15' GROUP BY 1, 2"""
_O["event_history"] = _with("chain_events") + """SELECT epoch_us(timestamp) AS timestamp_us, program_id, event_type, signature, payload
FROM chain_events WHERE program_id = 'Prog3' AND event_type = 'transaction' AND timestamp >= TIMESTAMP '2024-01-05'
AND timestamp <= TIMESTAMP '2024-01-25 12:00:00' ORDER BY timestamp DESC, event_id DESC LIMIT 200 OFFSET 20"""
_O["half_open_window"] = _with("chain_events") + """SELECT event_id, epoch_us(timestamp) AS timestamp_us FROM chain_events
WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11 06:00:00'"""
_O["valid_program_ids"] = _with("launch_requests") + f"""SELECT launch_idx, raw_program AS program_id, {_base58('program_id')} AS is_valid
FROM launch_requests"""
_O["valid_identifiers"] = _with("route_requests") + """SELECT route_id, event_type,
regexp_full_match(event_type, '[A-Za-z0-9_.:-]+') AS is_valid FROM route_requests"""
_O["program_access"] = _with("chain_events") + """, programs AS (SELECT DISTINCT program_id FROM chain_events)
SELECT 'subject' || s_suppkey AS subject, program_id FROM supplier, programs WHERE s_suppkey % 19 = 0
OR s_suppkey % 7 < 2 OR program_id = 'Prog' || (1 + s_suppkey % 9) OR program_id = 'Prog' || (1 + s_suppkey % 5)"""
_O["visible_events"] = _with("chain_events") + "SELECT event_id, program_id FROM chain_events WHERE program_id IN ('Prog2', 'Prog5')"
_O["due_monitors"] = _with("monitors", "last_now") + f"""SELECT monitor_id, last_us AS last_evaluated_at_us FROM monitors
LEFT JOIN last_now USING (monitor_id) WHERE is_active AND (last_us IS NULL OR {_NOW_US} - last_us >= schedule_minutes::BIGINT * 60000000)"""
_O["threshold_predicate"] = """SELECT event_id AS evaluation_id, CASE event_id % 5 WHEN 0 THEN value > 20 WHEN 1 THEN value >= 20
WHEN 2 THEN value < 20 WHEN 3 THEN value <= 20 END AS met FROM events"""
_O["route_match_predicate"] = _with("chain_events") + """SELECT event_id, program_id = 'Prog4' AND event_type = 'transaction' AS both,
program_id = 'Prog4' AS program, event_type = 'account' AS type, true AS any FROM chain_events"""
_O["readonly_guard"] = _with("cleaned") + f"""SELECT doc_id, sha256(c) AS clean_hash, CASE WHEN c = '' THEN 'sql query is empty'
WHEN contains(c, '--') OR contains(c, '/*') OR contains(c, '*/') THEN 'sql comments are not allowed'
WHEN contains(c, ';') THEN 'multiple statements are not allowed'
WHEN NOT regexp_matches(c, '^(select|with)', 'i') THEN 'only read-only SELECT queries are allowed'
WHEN regexp_matches(c, '\\b({_UNSAFE})\\b', 'i') THEN 'query contains unsupported keywords' END AS reject_reason FROM cleaned"""
_O["table_reference_check"] = _with("texts") + r"SELECT doc_id, regexp_matches(lower(q), '\bchain_events\b') AS mentioned FROM texts"
_O["valid_webhook_urls"] = f"""SELECT page_id, u AS url, {_url('u')} AS is_valid FROM (SELECT page_id, CASE page_id % 10
WHEN 1 THEN replace(url, '://', ':/') WHEN 2 THEN replace(replace(url, 'https', 'ftp'), 'http', 'FTP')
WHEN 3 THEN '  HTTP://user@' || page_id || '.example:80/a%20b ' WHEN 4 THEN 'http://:80/' || page_id
WHEN 5 THEN 'https:///' || page_id WHEN 6 THEN 'https://a b/' || page_id WHEN 7 THEN url || '/%zz' ELSE url END AS u FROM pages)"""
_O["registry_lookup"] = _with("registry") + "SELECT program_id, idl_name, CAST(idl_version AS VARCHAR) AS idl_version FROM registry WHERE program_id = 'part0' LIMIT 1"
_O["normalize_transactions"] = _with("tx_events") + "SELECT * FROM tx_events"
_O["normalize_accounts"] = _with("acc_events") + "SELECT * FROM acc_events"
_O["route_fanout"] = _with("matched") + "SELECT * EXCLUDE (ord) FROM matched"
_O["route_fanout_static"] = _with("matched_static") + "SELECT * EXCLUDE (ord) FROM matched_static"
_O["unique_targets"] = _with("matched_static") + """SELECT * EXCLUDE (ord) FROM matched_static
QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY ord) = 1"""
_COUNTS = (
    "baseline_events, baseline_unique_signatures, baseline_transactions, evaluation_events, "
    "evaluation_unique_signatures, evaluation_transactions"
)
_O["launch_window_join"] = _with("metrics") + f"SELECT launch_idx, program_id, {_COUNTS} FROM metrics"
_O["monitor_window_join"] = _with("values_now") + "SELECT monitor_id, program_id, window_minutes, value FROM values_now"
_O["monitor_last_state"] = _with("last_all") + """SELECT monitor_id, last_us AS last_evaluated_at_us, last_value,
sent_us AS last_triggered_at_us, last_fingerprint FROM last_all"""
_O["audit_for_monitor"] = _with("audit", "monitors") + """SELECT evaluation_id, at_us AS evaluated_at_us, value, delivery_state FROM audit
WHERE monitor_id = 3 AND monitor_id IN (SELECT monitor_id FROM monitors) ORDER BY at_us DESC, evaluation_id DESC LIMIT 50 OFFSET 5"""
_O["orphan_audit"] = _with("audit", "monitors") + """SELECT evaluation_id, monitor_id FROM audit a
WHERE NOT EXISTS (SELECT 1 FROM monitors m WHERE m.monitor_id = a.monitor_id)"""
_O["new_nonces"] = _chain(
    "SELECT user_id AS k, event_id AS i, epoch_us(ts) // 1000000 AS t, '' AS m FROM events", "36001"
) + "SELECT i AS event_id, k AS user_id, accepted AS fresh FROM chain"
_O["signal_exists"] = _with("judged") + """SELECT launch_idx, s1 AS event_growth, s2 AS unique_signer_growth,
s3 AS transaction_growth FROM judged"""
_O["count_last_day"] = _with("chain_events") + """SELECT count(*) AS events FROM chain_events
WHERE timestamp >= TIMESTAMP '2024-01-28 06:00:00'"""
_O["conditional_counts"] = _with("chain_events") + """SELECT program_id, count(*) FILTER (event_type = 'transaction') AS transactions,
count(*) FILTER (event_type <> 'transaction') AS accounts FROM chain_events GROUP BY 1"""
_O["conditional_distinct"] = _with("chain_events") + """SELECT program_id,
count(DISTINCT coalesce(signature, '')) FILTER (event_type = 'transaction') AS transaction_signers,
count(DISTINCT coalesce(signature, '')) AS signers FROM chain_events GROUP BY 1"""
_O["launch_backtest"] = _with("judged") + f"""SELECT launch_idx, name, program_id, {_text_time('at_us')} AS launch_at,
{_text_time('start_us')} AS baseline_start, {_text_time('end_us')} AS evaluation_end, {_COUNTS}, r1 AS event_growth_ratio,
r2 AS unique_signer_growth_ratio, r3 AS transaction_growth_ratio, score, outcome, CASE WHEN outcome = 'worked' THEN
'launch passed at least two growth signals with sufficient post-launch activity' ELSE
'launch did not meet required signal thresholds' END AS reason, concat_ws('|', CASE WHEN s1 THEN 'event_growth' END,
CASE WHEN s2 THEN 'unique_signer_growth' END, CASE WHEN s3 THEN 'transaction_growth' END) AS signals FROM judged"""
_O["launch_backtest_many"] = _with("checked_launches", "chain_events") + f"""SELECT launch_idx, program_id, launch_at, {_COUNTS}, score,
CASE WHEN score >= 2.0 AND evaluation_events >= 5 THEN 'worked' ELSE 'not_worked' END AS outcome FROM (SELECT *,
CAST((r1 >= 0.25)::INT + (r2 >= 0.30)::INT + (r3 >= 0.25)::INT AS DOUBLE)
+ CASE WHEN evaluation_events >= 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT *, {_RATIOS} FROM (
SELECT launch_idx, program_id, {_text_time('at_us')} AS launch_at, {_WINDOW_COUNTS} FROM
(SELECT launch_idx, program_id, (at_us // 1000000) * 1000000 AS at_us FROM checked_launches WHERE reject_reason IS NULL) LEFT JOIN {_FLAT}
ON p = program_id AND t >= at_us - 86400000000 AND t < at_us + 21600000000 GROUP BY launch_idx, program_id, at_us)))"""
_O["backtest_summary"] = _with("judged") + """SELECT count(*) AS total_launches, count(*) FILTER (outcome = 'worked') AS worked,
count(*) FILTER (outcome <> 'worked') AS not_worked FROM judged"""
_O["signal_leaderboard"] = _with("judged") + f"""SELECT signal, count(*) FILTER (hit) AS wins_in_launch
FROM {_SIGNAL_ROWS.format('judged')} GROUP BY signal ORDER BY 2 DESC, 1"""
_O["signal_performance"] = _with("judged") + _performance(_SIGNAL_ROWS.format("judged"))
_O["launch_score"] = _with("contributions") + """, c AS (SELECT launch_idx, any_value(prior) AS prior,
any_value(contribution) FILTER (signal = 'event_growth') AS c1, any_value(contribution) FILTER (signal = 'unique_signer_growth') AS c2,
any_value(contribution) FILTER (signal = 'transaction_growth') AS c3,
any_value(coverage) FILTER (signal = 'event_growth') AS v1, any_value(coverage) FILTER (signal = 'unique_signer_growth') AS v2,
any_value(coverage) FILTER (signal = 'transaction_growth') AS v3 FROM contributions GROUP BY 1),
p AS (SELECT f.launch_idx, c.prior, f.score, f.outcome, least(greatest(c.prior + c1 + c2 + c3
- CASE WHEN evaluation_events < 5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN score >= 2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END,
0.01::DOUBLE), 0.99::DOUBLE) AS probability, least(greatest(0.35::DOUBLE + least(1.0::DOUBLE, n / 20.0::DOUBLE) * 0.35::DOUBLE
+ (v1 + v2 + v3) / 3 * 0.2::DOUBLE + CASE WHEN evaluation_events >= 5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 0.05::DOUBLE), 0.95::DOUBLE)
AS confidence FROM future f JOIN c USING (launch_idx), prior)
SELECT launch_idx, prior AS prior_probability, probability, CASE WHEN probability >= 0.75 THEN 'high'
WHEN probability >= 0.45 THEN 'medium' ELSE 'low' END AS probability_band, confidence, score, outcome FROM p"""
_O["top_contributions"] = _with("contributions") + """SELECT launch_idx,
CAST(row_number() OVER (PARTITION BY launch_idx ORDER BY abs(contribution) DESC, signal) - 1 AS INTEGER) AS rank, signal,
contribution, hit AS candidate_triggered, precision, coverage, worked_with_signal, total_with_signal FROM contributions"""
_O["evidence_bundle"] = _with("chain_events") + """, v AS (SELECT 'program_id' AS field, program_id AS value, timestamp, event_id FROM chain_events
UNION ALL SELECT 'signature', signature, timestamp, event_id FROM chain_events WHERE signature IS NOT NULL
UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), timestamp, event_id FROM chain_events),
s AS (SELECT field, value, min((timestamp, event_id)) AS place FROM v GROUP BY 1, 2)
SELECT field, CAST(row_number() OVER w - 1 AS INTEGER) AS position, value, count(*) OVER (PARTITION BY field) AS total,
count(*) OVER (PARTITION BY field) > 100 AS truncated FROM s
WINDOW w AS (PARTITION BY field ORDER BY place) QUALIFY row_number() OVER w <= 100"""
_O["result_kpis"] = """WITH f AS (SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 1)
SELECT 0 AS position, 'as_text' AS metric, value FROM f UNION ALL SELECT 1, 'event_id', event_id FROM f
UNION ALL SELECT 2, 'user_id', user_id FROM f UNION ALL SELECT 3, 'value', value FROM f"""
_O["first_numeric"] = """SELECT 'user_text' AS metric, CAST(user_id AS DOUBLE) AS value FROM events
ORDER BY events.value DESC, ' ' || user_id DESC, event_type LIMIT 1"""
_O["request_stats"] = """SELECT CASE event_type WHEN 'click' THEN 'UNKNOWN' WHEN 'view' THEN 'POST' ELSE 'GET' END AS method,
CASE WHEN event_id % 50 = 0 THEN '/unknown' ELSE '/api/' || event_type END AS path,
CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status, count(*) AS requests,
CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS duration_sum_micros FROM events GROUP BY 1, 2, 3 ORDER BY 2, 1, 3"""
_O["stage_errors"] = """SELECT CASE WHEN event_id % 40 = 7 THEN 'unknown' WHEN event_type = 'error' THEN 'sql_validation'
ELSE event_type || '_stage_' || (event_id % 5) END AS stage, count(*) AS errors FROM events GROUP BY 1 ORDER BY 1"""
_O["ingest_counters"] = """SELECT count(*) AS events_total, count(*) FILTER (event_type <> 'error') AS published_total,
count(*) FILTER (event_type = 'error') AS publish_failures_total, count(*) FILTER (event_id % 13 = 0) AS delivery_failures_total,
max((epoch_us(ts) // 1000)) AS last_event_observed_ms, max((epoch_us(ts) // 1000)) FILTER (event_type <> 'error') AS last_publish_success_ms,
max((epoch_us(ts) // 1000)) FILTER (event_type = 'error') AS last_publish_failure_ms FROM events"""
_O["ingestion_lag"] = """SELECT greatest(1706700000000 - max((epoch_us(ts) // 1000)), 0) AS ingestion_lag_ms FROM events"""
_O["slo_error_rate"] = _with("rates") + "SELECT * FROM rates"
_HELD = """, runs AS (SELECT *, sum(CASE WHEN breached THEN 0 ELSE 1 END) OVER (ORDER BY step) AS run FROM checks),
since AS (SELECT *, min(step) FILTER (breached) OVER (PARTITION BY run ORDER BY step) AS start FROM runs)
SELECT {columns}, CASE WHEN NOT breached THEN 'inactive' WHEN (step - start) * 30 >= {hold} THEN 'firing' ELSE 'pending' END AS state
FROM since"""


def _objective(steps: int, above: float, hold: int) -> str:
    """The objectives as the rule file states them, on windows of whole 30 s steps."""
    return _with("deltas") + f""", cells AS (SELECT (at_us + 29999999) // 30000000 AS step, sum(de) AS de, sum(dr) AS dr FROM deltas GROUP BY 1),
    sums AS (SELECT step, sum(coalesce(dr, 0)) OVER f AS errors, sum(coalesce(de, 0)) OVER f AS total
      FROM (SELECT unnest(range(lo, hi + 1)) AS step FROM (SELECT min(step) AS lo, max(step) AS hi FROM cells)) g
      LEFT JOIN cells USING (step) WINDOW f AS (ORDER BY step ROWS BETWEEN {steps - 1} PRECEDING AND CURRENT ROW)),
    checks AS (SELECT step, errors / greatest(total, 1) AS ratio, errors / greatest(total, 1) > {above} AS breached FROM sums)
    """ + _HELD.format(columns="step, ratio, breached", hold=hold)


_O["slo_query_errors"] = _objective(10, 0.05, 600)
_O["slo_monitor_failures"] = _objective(20, 0.10, 900)
_O["slo_lag_hold"] = """WITH seen AS (SELECT DISTINCT epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT unnest(range(lo, hi + 1)) AS step FROM (SELECT min((ms + 29999) // 30000) AS lo, max(ms // 30000 + 1) AS hi FROM seen)),
checks AS (SELECT step, step * 30000 - ms > 120000 AS breached FROM g ASOF JOIN seen ON seen.ms <= g.step * 30000)
""" + _HELD.format(columns="step, breached", hold=600)
_O["conditional_distinct_bound"] = _with("chain_events") + """SELECT DISTINCT program_id, true AS within FROM chain_events
WHERE event_type = 'transaction'"""
_O["slo_lag_level"] = """SELECT event_id, CASE WHEN (epoch_us(ts) // 1000) % 180000 >= 120000 THEN 'red' WHEN (epoch_us(ts) // 1000) % 180000 >= 60000
THEN 'orange' ELSE 'green' END AS lag_level, CASE WHEN event_id % 13 >= 5 THEN 'red' WHEN event_id % 13 >= 3 THEN 'orange'
ELSE 'green' END AS query_level, CASE WHEN event_id % 13 >= 10 THEN 'red' WHEN event_id % 13 >= 5 THEN 'orange' ELSE 'green' END
AS monitor_level FROM events"""
_O["latest_metric"] = _with("samples") + """SELECT instance || ':executions' AS metric, arg_max(executions, (at_us, sample_id)) AS value
FROM samples GROUP BY 1 UNION ALL SELECT instance || ':errors', arg_max(errors, (at_us, sample_id)) FROM samples GROUP BY 1"""
_O["counter_increase"] = _with("deltas") + """SELECT sample_id, instance, sum(de) OVER (PARTITION BY instance ORDER BY at_us
RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS increase FROM deltas"""
_O["alert_for_duration"] = _with("rates") + """, runs AS (SELECT *, sum(CASE WHEN breached THEN 0 ELSE 1 END) OVER (ORDER BY step) AS run FROM rates),
since AS (SELECT *, min(step) FILTER (breached) OVER (PARTITION BY run ORDER BY step) AS start FROM runs)
SELECT step, breached, CASE WHEN NOT breached THEN 'inactive' WHEN (step - start) * 30 >= 1800 THEN 'firing' ELSE 'pending' END AS state
FROM since"""
_TRIGGERED = "SELECT monitor_id AS k, evaluation_id AS i, at_us AS t, dedupe_key AS m FROM audit WHERE triggered"
_STATE = """SELECT i AS evaluation_id, CASE WHEN accepted THEN 'sent' WHEN t - anchor < 86400000000 THEN 'cooldown'
ELSE 'deduped' END AS delivery_state, anchor AS last_sent_us FROM chain"""
_O["cooldown_suppress"] = _chain(_TRIGGERED, "86400000000", "0", ("audit",)) + _STATE
_O["dedupe_suppress"] = _chain(_TRIGGERED, "86400000000", "432000000000", ("audit",)) + _STATE
_O["rate_limit_audit"] = _chain(
    "SELECT user_id AS k, event_id AS i, epoch_us(ts) AS t, '' AS m FROM events", "86400000000"
) + "SELECT i AS request_id, k AS key, pos <= 2 AS allowed, greatest(2 - pos, 0) AS remaining FROM chain"
_O["dense_position"] = _with("steps") + "SELECT slot, CAST(i AS INTEGER) AS instruction_index, pidx AS program_id_index FROM steps"
_O["registry_page"] = _with("registry_rows") + """SELECT program_id, epoch_us(updated_at) AS updated_at_us FROM registry_rows
ORDER BY updated_at DESC, program_id LIMIT 500 OFFSET 10"""
_O["monitor_page"] = _with("monitors") + """SELECT monitor_id, program_id, epoch_us(updated_at) AS updated_at_us FROM monitors
WHERE program_id IN ('', 'Prog1', 'Prog4') ORDER BY updated_at DESC, monitor_id LIMIT 100"""
_O["routes_by_created"] = _with("route_requests") + """SELECT route_id, epoch_us(created_at) AS created_at_us FROM route_requests
ORDER BY created_at DESC, route_id"""
_O["audit_page"] = _with("audit") + """SELECT evaluation_id, monitor_id, at_us AS evaluated_at_us FROM audit
ORDER BY at_us DESC, evaluation_id DESC LIMIT 120 OFFSET 30"""
_O["inbound_page"] = _with("verified") + """SELECT request_id, nonce, received_us AS received_at_us FROM verified WHERE reject_reason IS NULL
ORDER BY received_us DESC, request_id DESC LIMIT 40"""
_O["capped_query"] = _with("chain_events") + """SELECT event_id, program_id, slot FROM chain_events ORDER BY slot DESC, event_id LIMIT 1000"""
_O["validate_launches"] = _with("checked_launches") + """SELECT launch_idx, name, program_id, at_us AS launch_ts_us, reject_reason
FROM checked_launches"""
_SET = (
    "schedule_minutes, window_minutes, cooldown_minutes, dedupe_minutes, retry_max_attempts, retry_initial_backoff_ms"
)
_O["validate_monitors"] = _with("checked_monitors") + f"""SELECT monitor_id, name, program_id, comparator, {_SET}, reject_reason
FROM checked_monitors"""
_cte(
    "patched",
    """SELECT * REPLACE (CASE WHEN n IS NULL THEN name ELSE trim(n) END AS name, coalesce(lower(cm), comparator) AS comparator,
    coalesce(th, threshold) AS threshold, CASE WHEN wm IS NULL THEN window_minutes WHEN wm <= 0 THEN 60 ELSE wm END AS window_minutes,
    coalesce(ia, is_active) AS is_active) FROM monitors LEFT JOIN (SELECT c_custkey + 1 AS monitor_id,
    CASE c_custkey % 5 WHEN 0 THEN 'new ' || c_name WHEN 1 THEN ' ' END AS n,
    CASE c_custkey % 4 WHEN 0 THEN 'GTE' WHEN 1 THEN 'between' END AS cm, CASE WHEN c_custkey % 2 = 0 THEN 7.5::DOUBLE END AS th,
    CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 7 = 1 THEN 30000 END AS wm,
    CASE WHEN c_custkey % 11 = 0 THEN false END AS ia FROM customer) USING (monitor_id)""",
    "monitors",
)
_O["patch_monitors"] = _with("patched") + f"""SELECT monitor_id, name, comparator, threshold, window_minutes, is_active,
coalesce(CASE WHEN n = ' ' THEN 'name cannot be empty' END, {_MONITOR_REASON}) AS reject_reason FROM patched"""
_cte(
    "merged",
    """SELECT coalesce(r.program_id, c.pid) AS program_id, r.name AS old_name, r.content AS old_content, r.updated_at AS old_updated,
    r.program_id IS NOT NULL AS was_known,
    c.nm, c.ct, CASE WHEN c.pid IS NULL THEN 'unchanged'
    WHEN action = 'create' AND (ct IS NULL OR NOT json_valid(ct)) THEN 'invalid'
    WHEN action = 'create' THEN CASE WHEN r.program_id IS NULL THEN 'created' ELSE 'duplicate' END
    WHEN action = 'update' AND ((ct IS NOT NULL AND NOT json_valid(ct)) OR (ct IS NULL AND nm IS NULL)) THEN 'invalid'
    WHEN r.program_id IS NULL THEN 'missing' WHEN action = 'update' THEN 'updated' ELSE 'deleted' END AS result
    FROM registry_rows r FULL JOIN (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'part' END || s_suppkey AS pid,
      CASE s_suppkey % 4 WHEN 0 THEN 'create' WHEN 2 THEN 'delete' ELSE 'update' END AS action,
      CASE WHEN s_suppkey % 5 < 3 THEN s_name END AS nm,
      CASE WHEN s_suppkey % 7 = 0 THEN '{oops' WHEN s_suppkey % 7 > 2 THEN '{"name":"' || s_suppkey || '"}' END AS ct FROM supplier) c
    ON c.pid = r.program_id""",
    "registry_rows",
)
_cte(
    "merged_rows",
    """SELECT program_id, CASE WHEN result IN ('created', 'updated') THEN coalesce(nm, old_name, '') ELSE old_name END AS name,
    CASE WHEN result IN ('created', 'updated') THEN coalesce(ct, old_content) ELSE old_content END AS content, result, was_known,
    CASE WHEN result IN ('created', 'updated') THEN epoch_us(TIMESTAMP '2024-01-29 06:00:00') ELSE epoch_us(old_updated) END AS updated_at_us FROM merged""",
    "merged",
)
_O["registry_merge"] = _with("merged_rows") + "SELECT program_id, name, content, result, was_known FROM merged_rows"
_O["registry_snapshot"] = _with("merged_rows") + """SELECT program_id, name, content, updated_at_us FROM merged_rows
WHERE result = 'created' OR (was_known AND result <> 'deleted')"""
_O["validate_routes"] = _with("route_requests") + """SELECT route_id, trim(url) AS url, trim(program_id) AS program_id, event_type,
CASE WHEN trim(url) = '' THEN 'url is required' WHEN NOT regexp_matches(trim(url), '^https?://[a-z]') THEN 'url is invalid'
WHEN program_id = 'Prog0' THEN 'program_id must be base58' WHEN event_type = 'two words' THEN 'event_type contains unsupported characters'
END AS reject_reason FROM route_requests"""
_O["purge_audit"] = """SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-19 06:00:00') AS kept,
count(*) FILTER (ts < TIMESTAMP '2024-01-19 06:00:00') AS purged FROM events"""
_O["purge_nonces"] = """SELECT event_id, (epoch_us(ts) // 1000000) * 1000000 + 600000000 AS expires_us FROM events
WHERE epoch_us(ts) // 1000000 + 600 >= 1705276800"""
_O["verify_inbound"] = _with("verified") + "SELECT request_id, received_us AS received_at_us, reject_reason FROM verified"
_FRESH = _chain(
    f"SELECT {_strip('nonce')} AS k, request_id AS i, received_us AS t, '' AS m FROM verified WHERE reject_reason IS NULL",
    "600000001", "0", ("verified",),
)
_O["accept_inbound"] = _FRESH + "SELECT i AS request_id, k AS nonce, accepted AS fresh FROM chain"
_O["land_inbound"] = _FRESH + f"""SELECT request_id, {_strip('nonce')} AS nonce, key_id, source_ip, body AS payload,
received_us AS received_at_us FROM chain JOIN verified ON request_id = i WHERE accepted"""
_O["growth_ratios"] = _with("chain_events") + f"""SELECT signer, {_ratio('b', 'a')} AS ratio FROM (SELECT coalesce(signature, '') AS signer,
count(*) FILTER (timestamp < TIMESTAMP '2024-01-16') AS b,
count(*) FILTER (timestamp >= TIMESTAMP '2024-01-16') AS a FROM chain_events GROUP BY 1)"""
_O["probability_bands"] = """SELECT event_id, p, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT event_id, least(greatest((event_id % 120) / 100.0::DOUBLE - 0.05::DOUBLE, 0.01::DOUBLE), 0.99::DOUBLE) AS p FROM events)"""
_O["report_verdicts"] = """SELECT event_id, CASE WHEN r = 0 THEN 'insufficient_data' WHEN k = 0 THEN 'watch' WHEN v <= 0 THEN 'critical'
WHEN a <> 1 THEN CASE WHEN v < 1 THEN 'critical' WHEN v < 10 THEN 'watch' ELSE 'healthy' END
WHEN v < 1 THEN 'watch' ELSE 'healthy' END AS verdict,
least(0.45::DOUBLE + CASE WHEN r > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r >= 5 THEN 0.1::DOUBLE ELSE 0 END
+ CASE WHEN k > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN k >= 3 THEN 0.05::DOUBLE ELSE 0 END, 0.95::DOUBLE) AS confidence,
CASE WHEN a = 1 THEN 'gt' ELSE 'lt' END AS comparator,
CASE WHEN r = 0 THEN 0.0::DOUBLE WHEN a = 1 THEN v::DOUBLE * 1.3::DOUBLE ELSE v::DOUBLE * 0.7::DOUBLE END AS threshold_hint
FROM (SELECT event_id, event_id % 7 AS r, event_id % 4 AS k, event_id % 25 - 3 AS v, event_id % 3 AS a FROM events)"""
_O["sql_hashes"] = _with("texts") + f"SELECT doc_id, sha256({_strip('q')}) AS sql_hash FROM texts"
_O["request_signatures"] = f"SELECT doc_id, {_hmac('CAST(n_chars AS VARCHAR)', chr(39) + 'n' + chr(39) + ' || doc_id', 'text')} AS signature FROM documents"
_O["dedupe_keys"] = _with("audit") + """SELECT evaluation_id, sha256(printf('%d|%s|%s|%s|%.6f|%.6f', monitor_id, reason, comparator,
query, threshold, value)) AS dedupe_key FROM audit"""
_O["event_keys"] = _with("raw_tx", "raw_acc") + """SELECT coalesce(signature, 'unknown-signature') || ':' || slot || ':0' AS event_id,
coalesce(signature, own_keys[1]) AS partition_key FROM raw_tx
UNION ALL SELECT slot || ':' || pubkey || ':account', coalesce(signature, pubkey) FROM raw_acc"""
_O["plain_base64"] = "SELECT doc_id, sha256(base64(encode(text))) AS encoded_hash FROM documents"
_O["numeric_texts"] = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN value WHEN 2 THEN value WHEN 3 THEN CAST(value || 'e2' AS DOUBLE)
WHEN 5 THEN CAST('0.' || event_id AS DOUBLE) END AS number FROM events"""
_O["webhook_times"] = _with("launch_requests") + f"""SELECT launch_idx, u AS at_us, {_text_time('u')} AS at_text
FROM (SELECT launch_idx, CASE WHEN launch_idx % 2 = 0 THEN (launch_idx * 86400 - 500) * 1000000 ELSE at_us END AS u FROM launch_requests)"""
_O["rendered_templates"] = _with("monitor_requests") + """SELECT monitor_id, replace(replace(replace(query_template, '{{program_id}}',
program_id || '''''x'), '{{from}}', '2024-01-01T00:00:00Z'), '{{to}}', '2024-01-02T00:00:00Z') AS sql_text FROM monitor_requests"""
_O["json_validity"] = _with("inbound") + "SELECT request_id, json_valid(body) AS is_json FROM inbound"
_GUARDED = "SELECT program_id, count(*) AS events, max(slot) AS slot FROM chain_events GROUP BY program_id"
_O["guarded_sql"] = _with("chain_events") + _GUARDED + " ORDER BY program_id LIMIT 100"
_TEXT = (
    "SELECT program_id, count(*) AS events, max(slot) AS slot FROM chain_events GROUP BY program_id ORDER BY program_id"
)
_O["verified_answer"] = _with("chain_events") + f""", r AS ({_GUARDED}) SELECT CAST(count(*) AS INTEGER) AS row_count,
100 AS row_limit, 'Query returned ' || count(*) || ' rows.' AS verified_answer, 'gt' AS suggested_comparator,
arg_min(events, program_id) * 1.3::DOUBLE AS threshold_hint, sha256('{_TEXT}') AS sql_hash_sha256,
string_agg(program_id, '|' ORDER BY program_id) AS program_ids,
(SELECT string_agg(slot, '|' ORDER BY place) FROM (SELECT CAST(slot AS VARCHAR) AS slot, min(program_id) AS place FROM r GROUP BY 1)) AS slots,
0 AS signature_count, CAST(count(*) AS INTEGER) AS sample_count FROM r"""
_O["analyst_report"] = _with("chain_events") + f""", r AS ({_GUARDED}), f AS (SELECT count(*) AS n, arg_min(events, program_id) AS k FROM r)
SELECT CASE WHEN k < 1 THEN 'critical' WHEN k < 10 THEN 'watch' ELSE 'healthy' END AS verdict,
0.45::DOUBLE + 0.2::DOUBLE + CASE WHEN n >= 5 THEN 0.1::DOUBLE ELSE 0 END + 0.2::DOUBLE AS confidence,
CASE WHEN k < 10 THEN 'Query executed and indicates a watch-level condition; monitor closely.' ELSE
'Query executed and metrics appear healthy for the requested scope.' END AS executive_summary, CAST(n AS INTEGER) AS row_count,
'events|slot' AS kpi_names, CAST(k AS DOUBLE) AS first_kpi, printf('Top KPI `events` has value %.4f.', k::DOUBLE) AS finding,
'1.0' AS report_version, 'Review suggested automation and tune threshold before activating in production.' AS action,
'lt' AS comparator, k * 0.7::DOUBLE AS threshold_hint, 60 AS schedule_minutes,
'single read-only statement|no SQL comments|execution evidence attached|table reference validated' AS checks FROM f"""
_O["monitor_evaluation"] = _with("evaluated") + f"""SELECT monitor_id, value, triggered, dedupe_key, delivery_state, CASE delivery_state
WHEN 'not_triggered' THEN 'condition not met' WHEN 'dry_run' THEN 'triggered in dry-run mode (no webhook sent)'
WHEN 'cooldown' THEN 'triggered but still in cooldown' WHEN 'deduped' THEN 'triggered but dedupe window suppressed duplicate alert'
ELSE 'triggered and handed to delivery' END AS reason, {_RENDERED} AS query FROM evaluated WHERE is_active"""
_cte(
    "outbox",
    f"""SELECT monitor_id, webhook_url AS url, '1706508000' AS sent_at, sha256(monitor_id || '|' || dedupe_key || '|1706508000') AS nonce,
    'key-one' AS key_id, least(retry_max_attempts, 10) AS max_attempts, CAST(to_json({{'event': 'agent_automation_triggered',
    'automation_id': monitor_id, 'name': name, 'program_id': program_id, 'value': value, 'threshold': threshold, 'comparator': comparator,
    'triggered': triggered, 'query': {_RENDERED}, 'window_from': from_text, 'window_to': '2024-01-29T06:00:00Z',
    'evaluated_at': '2024-01-29T06:00:00Z', 'delivery_state': delivery_state, 'dry_run': dry_run, 'dedupe_key': dedupe_key,
    'retry_attempts': 0}}) AS VARCHAR) AS body FROM evaluated WHERE is_active AND delivery_state = 'queued'""",
    "evaluated",
)
_O["delivery_outbox"] = _with("outbox") + f"SELECT *, 'v1=' || {_hmac('sent_at', 'nonce', 'body')} AS signature FROM outbox"

_O["monitor_two_ticks"] = _with("evaluated") + """SELECT monitor_id, 1::BIGINT AS deliveries FROM evaluated
WHERE is_active AND delivery_state = 'queued'"""

# Streams give the rows of their batch operators.
_O["stream_updates"] = _with("raw_tx", "raw_acc") + """SELECT 'transaction' AS kind, slot, signature FROM raw_tx
UNION ALL SELECT 'account', slot, signature FROM raw_acc"""
_cte("all_events", "SELECT * FROM tx_events UNION ALL SELECT * FROM acc_events", "tx_events", "acc_events")
_O["stream_normalize"] = _with("all_events") + "SELECT * FROM all_events"
_O["stream_publish_dlq"] = _with("all_events") + """SELECT event_id, CASE WHEN slot % 10 = 1 THEN 'dead_letter: topic unavailable'
ELSE 'published' END AS state FROM all_events"""
_O["stream_ingest_metrics"] = _with("all_events") + """SELECT count(*) AS events_total, count(*) AS published_total,
0 AS publish_failures_total, max(observed_at_unix_ms) AS last_event_observed_ms FROM all_events"""
_O["stream_fanout"] = _with("all_events", "routes") + """SELECT event_id, route_id, url, source FROM (
SELECT event_id, CAST(r.route_id AS VARCHAR) AS route_id, r.route_id AS ord, url, 'registry' AS source FROM all_events e JOIN routes r
ON 'part' || r.route_id = e.program_id AND (r.event_type IS NULL OR r.event_type = e.event_type)
UNION ALL SELECT event_id, 'static-env', 1000000, 'https://hook3.example/in', 'env' FROM all_events)
QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY ord) = 1"""
_O["event_outbox"] = _with("tx_events", "routes") + f"""SELECT event_id, route_id, url, sha256(body) AS body_hash,
'v1=' || {_hmac("'1706508000'", "sha256(event_id || '|' || route_id)", "body")} AS signature, 3 AS max_attempts FROM (
SELECT *, CAST(to_json({{'agent_context': 'chain event', 'delivery_target': {{'event_type_filter': tf, 'program_id_filter': pf,
'route_id': route_id, 'source': source}}, 'event': {{'event_id': event_id, 'event_type': event_type, 'program_id': program_id, 'slot': slot,
'signature': signature, 'partition_key': partition_key, 'source_endpoint': source_endpoint, 'observed_at_unix_ms': observed_at_unix_ms,
'payload': payload}}, 'timestamp_ms': 1706508000000}}) AS VARCHAR) AS body FROM (
SELECT e.*, CAST(r.route_id AS VARCHAR) AS route_id, r.route_id AS ord, url, 'part' || r.route_id AS pf, coalesce(r.event_type, '*') AS tf,
'registry' AS source FROM tx_events e JOIN routes r
ON 'part' || r.route_id = e.program_id AND (r.event_type IS NULL OR r.event_type = e.event_type)
UNION ALL SELECT *, 'static-env', 1000000, 'https://hook3.example/in', '*', '*', 'env' FROM tx_events)
QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY ord) = 1)"""
_O["nonce_replay_filter"] = _O["new_nonces"]
_O["stream_rate_limit"] = _O["rate_limit_audit"]
_O["stream_alert_suppress"] = _O["dedupe_suppress"]
_O["dlq_replay_job"] = _O["dlq_backlog"]
_O["monitor_tick"] = _with("evaluated") + f"""SELECT monitor_id, value, delivery_state,
{_NOW_US} - window_minutes::BIGINT * 60000000 AS window_from_us FROM evaluated
WHERE is_active AND (last_us IS NULL OR {_NOW_US} - last_us >= schedule_minutes::BIGINT * 60000000)"""


# Texts of many forms, counted here by kind; kinds 6 to 10 cannot be evaluated.
_cte(
    "varied_monitors",
    f"""SELECT * EXCLUDE (reject_reason) FROM (SELECT *, {_MONITOR_REASON} AS reject_reason FROM (
    SELECT * EXCLUDE (query_template), c % 11 AS kind, CASE c % 11 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VARIED_TEXTS))} END
    AS query_template FROM monitor_requests)) WHERE reject_reason IS NULL AND is_active""",
    "monitor_requests",
)
_cte(
    "varied_values",
    f"""SELECT m.*, CASE kind WHEN 0 THEN n WHEN 1 THEN spread WHEN 2 THEN top WHEN 3 THEN round(nt / nullif(n, 0)::DOUBLE, 4)
      WHEN 4 THEN programs WHEN 5 THEN of_type END::DOUBLE AS value
    FROM varied_monitors m LEFT JOIN (
      SELECT monitor_id, count(e.event_id) AS n, max(slot) - min(slot) AS spread, count(*) FILTER (event_type = 'transaction') AS nt
      FROM varied_monitors q LEFT JOIN chain_events e ON e.program_id = q.program_id
        AND epoch_us(timestamp) >= {_NOW_US} - window_minutes::BIGINT * 60000000 AND epoch_us(timestamp) < {_NOW_US} GROUP BY 1) USING (monitor_id)
    LEFT JOIN (SELECT monitor_id, max(k) FILTER (by_sig) AS top, max(k) FILTER (NOT by_sig) AS of_type FROM (
      SELECT monitor_id, grouping(event_type) = 1 AS by_sig, count(*) AS k FROM (SELECT monitor_id, coalesce(signature, '') AS sig, event_type
        FROM varied_monitors q JOIN chain_events e ON e.program_id = q.program_id
        AND epoch_us(timestamp) >= {_NOW_US} - window_minutes::BIGINT * 60000000 AND epoch_us(timestamp) < {_NOW_US})
      GROUP BY GROUPING SETS ((monitor_id, sig), (monitor_id, event_type))) GROUP BY 1) USING (monitor_id)
    LEFT JOIN (SELECT monitor_id, count(DISTINCT e.program_id) AS programs FROM varied_monitors q LEFT JOIN chain_events e
      ON epoch_us(timestamp) >= {_NOW_US} - window_minutes::BIGINT * 60000000 WHERE kind = 4 GROUP BY 1) USING (monitor_id)""",
    "varied_monitors", "chain_events",
)
_evaluated("varied_evaluated", "varied_values", "last_now", _NOW_US)
_O["template_evaluation"] = _with("varied_evaluated") + """SELECT monitor_id, coalesce(value, 0.0) AS value, coalesce(triggered, false) AS triggered,
dedupe_key, delivery_state, CASE WHEN kind BETWEEN 7 AND 10 THEN 'query execution failed'
WHEN value IS NULL THEN 'failed to read metric value' ELSE '' END AS failure FROM varied_evaluated"""
_O["refused_texts"] = _with("monitor_requests") + f""", t AS (SELECT c % 11 AS kind, count(*) AS monitors FROM monitor_requests GROUP BY 1)
SELECT CASE kind {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VARIED_TEXTS))} END AS query_template, monitors,
CASE WHEN kind = 8 THEN 'table is not allowed: audit_log' END AS reason FROM t"""
_O["subject_answers"] = _with("chain_events") + """SELECT program_id, count(*) AS events, max(slot) AS slot, 'subject2' AS subject
FROM chain_events WHERE program_id = 'Prog3' GROUP BY 1
UNION ALL SELECT program_id, count(*), max(slot), 'subject4' FROM chain_events WHERE program_id = 'Prog5' GROUP BY 1"""


def _tick(i: int, now: str) -> None:
    earlier = "".join(
        f""" UNION ALL SELECT monitor_id, {t} AS at_us, -1 AS evaluation_id, delivery_state IN ('sent', 'queued') AS held, coalesce(dedupe_key, '')
        FROM settled{j} """ for j, t in enumerate(_TICKS[:i])
    )
    _cte(
        f"last{i}",
        f"""SELECT monitor_id, max(at_us) AS last_us, max(at_us) FILTER (held) AS sent_us,
        arg_max(dedupe_key, (at_us, evaluation_id)) FILTER (held) AS last_fingerprint
        FROM (SELECT monitor_id, at_us, evaluation_id, alert_sent AS held, dedupe_key FROM audit{earlier}) WHERE at_us < {now} GROUP BY 1""",
        "audit", *[f"settled{j}" for j in range(i)],
    )
    _cte(
        f"values{i}",
        f"""SELECT m.*, CAST(CASE m.metric WHEN 'events' THEN n WHEN 'transactions' THEN nt ELSE ns END AS DOUBLE) AS value
        FROM monitors m JOIN (SELECT monitor_id, count(t) AS n, count(t) FILTER (kind = 'transaction') AS nt,
          count(DISTINCT sig) AS ns FROM monitors q LEFT JOIN {_FLAT}
          ON p = q.program_id AND t >= {now} - q.window_minutes::BIGINT * 60000000 AND t < {now} WHERE is_active GROUP BY monitor_id)
        USING (monitor_id)""",
        "monitors", "chain_events",
    )
    _evaluated(f"evaluated{i}", f"values{i}", f"last{i}", now)
    _cte(
        f"settled{i}",
        f"""SELECT monitor_id, dedupe_key, {now} AS evaluated_at_us, CASE WHEN delivery_state = 'queued' AND monitor_id % 4 = 1 THEN 'failed'
        WHEN delivery_state = 'queued' AND monitor_id % 4 > 1 THEN 'sent' ELSE delivery_state END AS delivery_state FROM evaluated{i}""",
        f"evaluated{i}",
    )


_TICKS = [_NOW_US, "epoch_us(TIMESTAMP '2024-01-29 06:20:00')", "epoch_us(TIMESTAMP '2024-01-29 06:50:00')"]
for _i, _now in enumerate(_TICKS):
    _tick(_i, _now)
_O["monitor_three_ticks"] = _with("settled0", "settled1", "settled2") + """SELECT monitor_id, evaluated_at_us, delivery_state,
delivery_state = 'sent' AS alert_sent, CASE delivery_state WHEN 'sent' THEN 1 WHEN 'failed' THEN 3 ELSE 0 END AS retry_attempts,
CASE delivery_state WHEN 'failed' THEN 'webhook returned status 500' ELSE '' END AS error, CASE delivery_state
WHEN 'not_triggered' THEN 'condition not met' WHEN 'dry_run' THEN 'triggered in dry-run mode (no webhook sent)'
WHEN 'cooldown' THEN 'triggered but still in cooldown' WHEN 'deduped' THEN 'triggered but dedupe window suppressed duplicate alert'
WHEN 'sent' THEN 'triggered and webhook sent' WHEN 'failed' THEN 'triggered but webhook delivery failed after retries'
ELSE 'triggered and handed to delivery' END AS reason FROM (SELECT * FROM settled0 UNION ALL SELECT * FROM settled1 UNION ALL SELECT * FROM settled2)"""

_O["events_per_window"] = _with("chain_events") + """SELECT program_id, us // 21600000000 * 21600000000 AS window_start_us,
us // 21600000000 * 21600000000 + 21600000000 AS window_end_us, count(*) AS events, count(*) FILTER (event_type = 'transaction') AS transactions
FROM (SELECT *, epoch_us(timestamp) AS us FROM chain_events) GROUP BY 1, 2, 3"""
_O["events_per_session"] = _with("chain_events") + """, gaps AS (SELECT program_id, event_type, epoch_us(timestamp) AS us,
epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY program_id ORDER BY timestamp) AS gap FROM chain_events),
runs AS (SELECT *, sum(CASE WHEN gap <= 5400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY program_id ORDER BY us) AS run FROM gaps)
SELECT program_id, min(us) AS window_start_us, max(us) + 5400000000 AS window_end_us, count(*) AS events,
count(*) FILTER (event_type = 'transaction') AS transactions FROM runs GROUP BY program_id, run"""

_O["window_rollup"] = _with("chain_events") + f""", programs AS (SELECT DISTINCT program_id FROM chain_events),
w AS (SELECT program_id, hours FROM programs, (VALUES (1), (24), (168), (672)) h(hours))
SELECT w.program_id, hours, count(event_id) AS events, count(*) FILTER (event_type = 'transaction') AS transactions, true AS within
FROM w LEFT JOIN chain_events e ON e.program_id = w.program_id AND epoch_us(timestamp) < {_NOW_US}
AND epoch_us(timestamp) >= {_NOW_US} - hours * 3600000000::BIGINT GROUP BY 1, 2"""
