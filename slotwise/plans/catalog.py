"""The registered batch queries: one per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, scoring, signing, text, timing
from ..operators import (
    backtest as bt,
    dead_letters as dl,
    fanout,
    guard,
    history,
    inbound as ib,
    monitors as mon,
    normalize as norm,
    ordered_rules,
    registry as reg,
    rollups,
    service_levels as sl,
)
from ..schemas import AUDIT, EVENT_LOG
from ..session import use_utc, workspace
from ..sources import event_log, json_rows
from . import inputs
from .inputs import KEY_ID, NOW, SECRET, shape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SETTINGS = bt.Settings.of(
    baseline_hours=24, evaluation_hours=6, min_events=5, event_ratio=0.25, signer_ratio=0.30, transaction_ratio=0.25
)
DAY_US = 86_400_000_000
NOW_S = 1706508000
STATIC_URL = "https://hook3.example/in"
SUBSCRIBED = [f"part{i}" for i in range(0, 250, 3)]


def query(name: str):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        return run

    return keep


def us(column: str, name: str | None = None):
    return timing.micros(F.col(column)).alias(name or f"{column}_us")


def _events(spark, sf):
    return shape(spark, sf, "chain_events")


def _registry(spark, sf):
    return norm.load_registry(inputs.registry(spark, sf))


def _transactions(spark, sf):
    return norm.normalize_transactions(shape(spark, sf, "raw_transactions"), _registry(spark, sf))


def _routes(spark, sf):
    return norm.load_routes(shape(spark, sf, "routes"))


def _launches(spark, sf):
    checked = history.valid_launches(shape(spark, sf, "launches"))
    return checked.where("reject_reason IS NULL").drop("reject_reason")


def _backtest(spark, sf):
    return bt.backtest(_events(spark, sf), _launches(spark, sf), SETTINGS)


def _tables(spark, sf):
    """What guarded texts may read."""
    return {"chain_events": _events(spark, sf)}


def _monitors(spark, sf):
    return mon.accepted_monitors(shape(spark, sf, "monitor_requests"))


def _audit(spark, sf):
    return shape(spark, sf, "audit")


# --- scans, sources, sinks ---------------------------------------------------


@query("scan_events")
def scan_events(spark, sf):
    _events(spark, sf).createOrReplaceTempView("chain_events")
    rows = event_log.scan_table(spark)
    return rows.select(us("timestamp"), "event_id", "event_type", "program_id", "slot", "signature", "payload")


@query("subscription_filter")
def subscription_filter(spark, sf):
    kept = norm.subscribed_transactions(shape(spark, sf, "raw_transactions"), SUBSCRIBED)
    accounts = norm.subscribed_accounts(shape(spark, sf, "raw_accounts"), SUBSCRIBED)
    return kept.select(F.lit("transaction").alias("kind"), "slot", F.col("account_keys")[0].alias("subject")).unionByName(
        accounts.select(F.lit("account").alias("kind"), "slot", F.col("pubkey").alias("subject"))
    )


@query("load_registry")
def load_registry(spark, sf):
    return _registry(spark, sf)


@query("load_active_routes")
def load_active_routes(spark, sf):
    return norm.load_routes(shape(spark, sf, "route_requests"))


@query("read_json_rows")
def read_json_rows(spark, sf):
    path = workspace(spark, "rows")
    json_rows.write_json_rows(_events(spark, sf), path)
    return json_rows.read_json_rows(spark, path, EVENT_LOG).select(us("timestamp"), *EVENT_LOG.names[1:])


@query("export_json_rows")
def export_json_rows(spark, sf):
    return guard.json_rows(_events(spark, sf).select("event_id", "event_type", "program_id", "slot", "signature"))


def _letter_lines(spark, sf):
    events = norm.normalize_accounts(shape(spark, sf, "raw_accounts"), _registry(spark, sf))
    letters = json_rows.dead_letter_rows(events, F.col("observed_at_unix_ms") + 5, F.lit("publish failed"))
    lines = letters.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.col("event.slot"))
    broken = F.when(F.col("slot") % 97 == 1, F.concat(F.lit("{broken "), "slot")).otherwise(F.col("value"))
    return lines.select(broken.alias("value"))


def _letters(spark, sf):
    path = workspace(spark, "letters")
    _letter_lines(spark, sf).write.text(path)
    return json_rows.read_dead_letters(spark, path)


@query("read_dlq")
def read_dlq(spark, sf):
    return _letters(spark, sf).select(
        F.col("event.event_id").alias("event_id"), "failed_at_unix_ms", "error",
        F.when(F.col("event").isNull(), F.col("raw")).alias("bad_line"),
    )


@query("write_dlq")
def write_dlq(spark, sf):
    path = workspace(spark, "letters")
    letters = json_rows.dead_letter_rows(_transactions(spark, sf), F.lit(1706508000000), F.lit("topic unavailable"))
    json_rows.append_dead_letters(letters, path)
    return json_rows.read_dead_letters(spark, path).select(
        "failed_at_unix_ms", "error", "event.event_id", "event.program_id", "event.partition_key"
    )


@query("publish_events")
def publish_events(spark, sf):
    return norm.topic_records(_transactions(spark, sf))


@query("append_audit")
def append_audit(spark, sf):
    path = workspace(spark, "audit")
    made = mon.evaluate(_events(spark, sf), _monitors(spark, sf), _audit(spark, sf), NOW)
    event_log.append_audit(mon.audit_rows(made), path)
    return event_log.read_audit(spark, path).select(
        "monitor_id", "value", "triggered", "alert_sent", "delivery_state", us("evaluated_at"), us("window_from")
    )


@query("land_inbound")
def land_inbound(spark, sf):
    path = workspace(spark, "inbound")
    verified = ib.verify_requests(inputs.inbound(spark, sf), SECRET, KEY_ID)
    landed = event_log.rewrite(ib.accept_requests(verified).where("fresh").drop("fresh"), path)
    return landed.select("request_id", "nonce", "key_id", "source_ip", "payload", us("received_at"))


@query("channel_topics")
def channel_topics(spark, sf):
    return norm.channel_records(_events(spark, sf), "live").select("channel", "event_id")


@query("event_log_days")
def event_log_days(spark, sf):
    """Write the log by day, read a week of it back."""
    path = workspace(spark, "event-log")
    event_log.append_events(_events(spark, sf), path)
    week = event_log.read_events(spark, path, "2024-01-08T00:00:00Z", "2024-01-15T00:00:00Z")
    return week.groupBy("program_id", "event_type").agg(F.count("*").alias("events"), F.max("slot").alias("last_slot"))


# --- projections, filters, predicates ----------------------------------------


@query("event_history")
def event_history(spark, sf):
    page = history.event_history(
        _events(spark, sf), "Prog3", "transaction", "2024-01-05T00:00:00Z", "2024-01-25T12:00:00Z", limit=200, offset=20
    )
    return page.select(us("timestamp"), "program_id", "event_type", "signature", "payload")


@query("half_open_window")
def half_open_window(spark, sf):
    rows = history.half_open(_events(spark, sf), "2024-01-10T00:00:00Z", "2024-01-11T06:00:00Z")
    return rows.select("event_id", us("timestamp"))


@query("valid_program_ids")
def valid_program_ids(spark, sf):
    return history.with_program_check(shape(spark, sf, "launch_requests"), "program_id").select(
        "launch_idx", "program_id", "is_valid"
    )


@query("valid_identifiers")
def valid_identifiers(spark, sf):
    return history.with_identifier_check(shape(spark, sf, "route_requests"), "event_type").select(
        "route_id", "event_type", "is_valid"
    )


@query("program_access")
def program_access(spark, sf):
    """The programs each subject may see."""
    return history.program_access(_events(spark, sf), shape(spark, sf, "grants"))


@query("visible_events")
def visible_events(spark, sf):
    return history.visible_rows(_events(spark, sf), "read", ["Prog2", "Prog5"]).select("event_id", "program_id")


@query("due_monitors")
def due_monitors(spark, sf):
    end = history.utc_bound(NOW)
    state = mon.last_state(_audit(spark, sf).where(F.col("evaluated_at") < end))
    return history.due_monitors(_monitors(spark, sf), state, NOW).select("monitor_id", us("last_evaluated_at"))


@query("threshold_predicate")
def threshold_predicate(spark, sf):
    rows = _audit(spark, sf).withColumn(
        "comparator",
        F.element_at(
            F.array(*[F.lit(c) for c in (" GT", "gte", "lt ", "LTE", "ne")]), (F.col("evaluation_id") % 5 + 1).cast("int")
        ),
    )
    met = scoring.threshold_met(F.col("value"), F.col("comparator"), F.col("threshold"))
    return rows.select("evaluation_id", met.alias("met"))


@query("route_match_predicate")
def route_match_predicate(spark, sf):
    """Events accepted by one route with each combination of filters."""
    p, k = F.col("program_id"), F.col("event_type")
    none = F.lit(None).cast("string")
    cases = {
        "both": (F.lit("Prog4"), F.lit("transaction")), "program": (F.lit("Prog4"), none),
        "type": (none, F.lit("account")), "any": (none, none),
    }
    return _events(spark, sf).select(
        "event_id", *[fanout.route_matches(rp, rk, p, k).alias(name) for name, (rp, rk) in cases.items()]
    )


@query("readonly_guard")
def readonly_guard(spark, sf):
    guarded = guard.guard_texts(shape(spark, sf, "query_texts"), "sql_text")
    return guarded.select("doc_id", F.sha2("clean_sql", 256).alias("clean_hash"), "reject_reason")


@query("table_reference_check")
def table_reference_check(spark, sf):
    texts = shape(spark, sf, "query_texts")
    return texts.select("doc_id", guard.references_table(F.col("sql_text"), "chain_events").alias("mentioned"))


@query("valid_webhook_urls")
def valid_webhook_urls(spark, sf):
    pages = inputs.table(spark, sf, "pages").select("page_id", "url")
    kind = F.col("page_id") % 10
    bent = (
        F.when(kind == 1, F.replace("url", F.lit("://"), F.lit(":/")))
        .when(kind == 2, F.replace(F.replace("url", F.lit("https"), F.lit("ftp")), F.lit("http"), F.lit("FTP")))
        .when(kind == 3, F.concat(F.lit("  HTTP://user@"), F.col("page_id").cast("string"), F.lit(".example:80/a%20b ")))
        .when(kind == 4, F.concat(F.lit("http://:80/"), "page_id"))
        .when(kind == 5, F.concat(F.lit("https:///"), "page_id"))
        .when(kind == 6, F.concat(F.lit("https://a b/"), "page_id"))
        .when(kind == 7, F.concat("url", F.lit("/%zz")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", bent.alias("url")).withColumn("is_valid", text.is_http_url(F.col("url")))


@query("registry_lookup")
def registry_lookup(spark, sf):
    return history.point_lookup(_registry(spark, sf), "program_id", "part0")


# --- joins -------------------------------------------------------------------


@query("normalize_transactions")
def normalize_transactions(spark, sf):
    return _transactions(spark, sf)


@query("normalize_accounts")
def normalize_accounts(spark, sf):
    return norm.normalize_accounts(shape(spark, sf, "raw_accounts"), _registry(spark, sf))


@query("route_fanout")
def route_fanout(spark, sf):
    matched = fanout.matched_routes(_events(spark, sf).select("event_id", "program_id", "event_type"), _routes(spark, sf))
    return matched.select("event_id", "route_id", "url", "program_id_filter", "event_type_filter", "source")


@query("route_fanout_static")
def route_fanout_static(spark, sf):
    events = _events(spark, sf).select("event_id", "program_id", "event_type")
    return fanout.matched_routes(events, _routes(spark, sf), STATIC_URL).select("event_id", "route_id", "url", "source")


@query("unique_targets")
def unique_targets(spark, sf):
    events = _events(spark, sf).select("event_id", "program_id", "event_type")
    made = fanout.matched_routes(events, _routes(spark, sf), STATIC_URL, unique_urls=True)
    return made.select("event_id", "route_id", "url", "source")


@query("launch_window_join")
def launch_window_join(spark, sf):
    windows = bt.launch_windows(_launches(spark, sf), SETTINGS)
    return bt.window_metrics(_events(spark, sf), windows).select("launch_idx", "program_id", *bt.COUNTS)


@query("monitor_window_join")
def monitor_window_join(spark, sf):
    values = mon.monitor_values(_events(spark, sf), _monitors(spark, sf), NOW)
    return values.select("monitor_id", "program_id", "window_minutes", "value")


@query("monitor_last_state")
def monitor_last_state(spark, sf):
    return mon.last_state(_audit(spark, sf)).select(
        "monitor_id", us("last_evaluated_at"), "last_value", us("last_triggered_at"), "last_fingerprint"
    )


@query("audit_for_monitor")
def audit_for_monitor(spark, sf):
    found = mon.audit_for_monitor(_audit(spark, sf), _monitors(spark, sf), 3)
    newest = [F.desc("evaluated_at"), F.desc("evaluation_id")]
    return history.page(found, newest, 50, 5).select("evaluation_id", us("evaluated_at"), "value", "delivery_state")


@query("orphan_audit")
def orphan_audit(spark, sf):
    return mon.orphan_audit(_audit(spark, sf), _monitors(spark, sf)).select("evaluation_id", "monitor_id")


@query("new_nonces")
def new_nonces(spark, sf):
    """Every event presents its user's nonce; ttl of ten minutes times 60."""
    rows = inputs.table(spark, sf, "events").select(
        "event_id", "user_id", F.floor(timing.micros(F.col("ts")) / 1_000_000).alias("received_s")
    )
    rows = rows.withColumn("received_us", F.col("received_s") * 1_000_000)
    made = ordered_rules.new_nonces(rows, "user_id", "received_us", "event_id", 36_000 * 1_000_000)
    return made.select("event_id", "user_id", "fresh")


@query("signal_exists")
def signal_exists(spark, sf):
    return _backtest(spark, sf).select("launch_idx", *[bt.has_signal(s).alias(s) for s in scoring.SIGNALS])


# --- aggregations ------------------------------------------------------------


@query("count_last_day")
def count_last_day(spark, sf):
    return history.count_last_day(_events(spark, sf), NOW)


@query("conditional_counts")
def conditional_counts(spark, sf):
    sent = F.col("event_type") == "transaction"
    return _events(spark, sf).groupBy("program_id").agg(
        F.count_if(sent).alias("transactions"), F.count_if(~sent).alias("accounts")
    )


@query("conditional_distinct")
def conditional_distinct(spark, sf):
    signer = F.coalesce("signature", F.lit(""))
    per_signer = _events(spark, sf).groupBy("program_id", signer.alias("signer")).agg(
        F.count_if(F.col("event_type") == "transaction").alias("sent")
    )
    return per_signer.groupBy("program_id").agg(
        F.count_if(F.col("sent") > 0).alias("transaction_signers"), F.count("*").alias("signers")
    )


@query("conditional_distinct_approx")
def conditional_distinct_approx(spark, sf):
    sent = F.when(F.col("event_type") == "transaction", F.coalesce("signature", F.lit("")))
    return _events(spark, sf).groupBy("program_id").agg(F.approx_count_distinct(sent, 0.02).alias("transaction_signers"))


@query("conditional_distinct_bound")
def conditional_distinct_bound(spark, sf):
    """Whether each approximate count lies within three standard errors of the exact one."""
    signer = F.coalesce("signature", F.lit(""))
    sent = _events(spark, sf).where("event_type = 'transaction'").select("program_id", signer.alias("signer"))
    exact = sent.distinct().groupBy("program_id").agg(F.count("*").alias("exact"))
    close = F.abs(F.col("transaction_signers") - F.col("exact")) <= 3 * 0.02 * F.col("exact")
    return exact.join(conditional_distinct_approx(spark, sf), "program_id").select("program_id", close.alias("within"))


@query("window_rollup")
def window_rollup(spark, sf):
    """Four windows of every program from an hourly rollup written once; whether distinct signers lie within
    three standard errors of the exact count over the events."""
    path, events = workspace(spark, "rollup"), _events(spark, sf)
    made = rollups.hourly_rollup(events)
    made.write.parquet(path)
    rollup = spark.read.schema(made.schema).parquet(path)
    end, hours = history.utc_bound(NOW), F.explode(F.array(*[F.lit(h) for h in (1, 24, 168, 672)])).alias("hours")
    windows = rollup.select("program_id").distinct().select("program_id", hours)
    windows = windows.withColumns({"window_start": end - F.make_dt_interval(hours=F.col("hours")), "window_end": end})
    found = rollups.windows_from_rollup(rollup, windows)
    # The longest window's events, a row for each signer's newest one, tell the exact counts.
    newest = events.where((F.col("timestamp") >= end - F.expr("INTERVAL 672 HOUR")) & (F.col("timestamp") < end)).groupBy(
        "program_id", F.coalesce("signature", F.lit("")).alias("signer")
    ).agg(F.max("timestamp").alias("at"))
    exact = windows.join(newest, "program_id").where(F.col("at") >= F.col("window_start")).groupBy("program_id", "hours").agg(F.count("*").alias("exact"))
    close = F.abs(F.col("signers") - F.coalesce("exact", F.lit(0))) <= 3 * 0.016 * F.coalesce("exact", F.lit(0))
    return found.join(exact, ["program_id", "hours"], "left").select("program_id", "hours", "events", "transactions", close.alias("within"))


@query("launch_backtest")
def launch_backtest(spark, sf):
    return _backtest(spark, sf).select(
        "launch_idx", "name", "program_id", "launch_at", "baseline_start", "evaluation_end", *bt.COUNTS,
        "event_growth_ratio", "unique_signer_growth_ratio", "transaction_growth_ratio", "score", "outcome", "reason",
        F.concat_ws("|", F.transform("signals", lambda s: s["signal"])).alias("signals"),
    )


@query("launch_backtest_many")
def launch_backtest_many(spark, sf):
    """One launch per customer, all against the whole log."""
    checked = history.valid_launches(shape(spark, sf, "launch_requests")).where("reject_reason IS NULL")
    result = bt.backtest(_events(spark, sf), checked.drop("reject_reason"), SETTINGS)
    return result.select("launch_idx", "program_id", "launch_at", *bt.COUNTS, "score", "outcome")


@query("backtest_summary")
def backtest_summary(spark, sf):
    return bt.summary(_backtest(spark, sf))


@query("signal_leaderboard")
def signal_leaderboard(spark, sf):
    return bt.signal_leaderboard(_backtest(spark, sf))


@query("signal_performance")
def signal_performance(spark, sf):
    return bt.signal_performance(_backtest(spark, sf))


def _scored(spark, sf):
    # Judged once: history and candidates are both read from what was written.
    judged = event_log.rewrite(_backtest(spark, sf), workspace(spark, "judged"))
    return bt.score_launches(judged.where("launch_idx < 16"), judged.where("launch_idx >= 16"), SETTINGS)


@query("launch_score")
def launch_score(spark, sf):
    return _scored(spark, sf).select(
        "launch_idx", "prior_probability", "probability", "probability_band", "confidence", "score", "outcome"
    )


@query("top_contributions")
def top_contributions(spark, sf):
    return _scored(spark, sf).select("launch_idx", F.posexplode("top_signals").alias("rank", "s")).select(
        "launch_idx", "rank", "s.signal", "s.contribution", "s.candidate_triggered", "s.precision", "s.coverage",
        "s.worked_with_signal", "s.total_with_signal",
    )


@query("evidence_bundle")
def evidence_bundle(spark, sf):
    return guard.evidence_values(_events(spark, sf), ["timestamp", "event_id"])


@query("result_kpis")
def result_kpis(spark, sf):
    rows = inputs.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("value").cast("string").alias("as_text"))
    return guard.result_kpis(rows, [F.desc("event_id")])


@query("first_numeric")
def first_numeric(spark, sf):
    rows = inputs.table(spark, sf, "events").select("event_type", F.concat(F.lit(" "), "user_id").alias("user_text"), "value")
    return guard.first_numeric(rows, [F.desc("value"), F.desc("user_text"), "event_type"])


@query("request_stats")
def request_stats(spark, sf):
    return sl.request_stats(shape(spark, sf, "requests"))


@query("stage_errors")
def stage_errors(spark, sf):
    return sl.stage_errors(shape(spark, sf, "requests"))


@query("ingest_counters")
def ingest_counters(spark, sf):
    return sl.ingest_counters(shape(spark, sf, "ingest_log"))


@query("ingestion_lag")
def ingestion_lag(spark, sf):
    return sl.ingestion_lag(shape(spark, sf, "ingest_log"), 1706700000000)


def _error_rate(spark, sf, objective=(43200, 1800, 0.05)):
    return sl.error_rate(shape(spark, sf, "metric_samples"), ["instance"], "errors", "executions", objective)


@query("slo_error_rate")
def slo_error_rate(spark, sf):
    return _error_rate(spark, sf).select("step", "errors_increase", "executions_increase", "ratio", "breached")


def _objective(spark, sf, objective):
    checks = sl.error_rate(shape(spark, sf, "metric_samples"), ["instance"], "errors", "executions", objective)
    return sl.alert_states(checks, objective[1]).select("step", "ratio", "breached", "state")


@query("slo_query_errors")
def slo_query_errors(spark, sf):
    return _objective(spark, sf, sl.QUERY_OBJECTIVE)


@query("slo_monitor_failures")
def slo_monitor_failures(spark, sf):
    """The monitors' objective, with the samples' errors and executions as failures and evaluations."""
    return _objective(spark, sf, sl.MONITOR_OBJECTIVE)


@query("slo_lag_hold")
def slo_lag_hold(spark, sf):
    return sl.alert_states(sl.lag_checks(shape(spark, sf, "ingest_log")), sl.LAG_HOLD).select("step", "breached", "state")


@query("slo_lag_level")
def slo_lag_level(spark, sf):
    """Bands of the gap before each ingested event and of the ratios."""
    log = shape(spark, sf, "ingest_log").select("event_id", (F.col("observed_at_unix_ms") % 180_000).alias("lag_ms"))
    ratio = (F.col("event_id") % 13) / F.lit(100.0)
    return log.select(
        "event_id", sl.level(F.col("lag_ms"), sl.LAG_LEVELS).alias("lag_level"),
        sl.level(ratio, sl.QUERY_LEVELS).alias("query_level"), sl.level(ratio, sl.MONITOR_LEVELS).alias("monitor_level"),
    )


def _replayed(spark, sf):
    letters = _letters(spark, sf)
    batch = dl.replay_batch(letters, 200)
    return letters, batch, batch.where(F.col("event.slot") % 10 != 1)


@query("dlq_backlog")
def dlq_backlog(spark, sf):
    return dl.backlog(*_replayed(spark, sf), threshold=200)


@query("dlq_remaining")
def dlq_remaining(spark, sf):
    letters, _, done = _replayed(spark, sf)
    left = json_rows.parse_dead_letters(dl.remaining(letters, done).withColumnRenamed("raw", "value"))
    return left.select(
        F.col("event.event_id").alias("event_id"), F.when(F.col("event").isNull(), F.col("raw")).alias("bad_line")
    )


@query("replay_batch")
def replay_batch(spark, sf):
    return dl.replay_batch(_letters(spark, sf), 200).select(
        F.col("event.event_id").alias("event_id"), F.when(F.col("event").isNull(), F.col("raw")).alias("bad_line")
    )


@query("latest_metric")
def latest_metric(spark, sf):
    samples = shape(spark, sf, "metric_samples")
    long = samples.select("ts", "sample_id", F.explode(F.array(
        F.struct(F.concat("instance", F.lit(":executions")).alias("metric"), F.col("executions").alias("value")),
        F.struct(F.concat("instance", F.lit(":errors")).alias("metric"), F.col("errors").alias("value")),
    )).alias("m")).select("ts", "sample_id", "m.*")
    return sl.latest_metrics(long)


# --- windows and sequences ---------------------------------------------------


@query("counter_increase")
def counter_increase(spark, sf):
    made = sl.counter_increase(shape(spark, sf, "metric_samples"), ["instance"], "executions", 6 * 3600, 24 * 3600 * sl.SECOND)
    return made.select("sample_id", "instance", "increase")


@query("alert_for_duration")
def alert_for_duration(spark, sf):
    return sl.alert_states(_error_rate(spark, sf), 1800).select("step", "breached", "state")


def _triggered(spark, sf):
    return _audit(spark, sf).where("triggered").select(
        "evaluation_id", "monitor_id", "evaluated_at", "dedupe_key",
        F.lit(1440).alias("cooldown_minutes"), F.lit(7200).alias("dedupe_minutes"),
    )


@query("cooldown_suppress")
def cooldown_suppress(spark, sf):
    rows = _triggered(spark, sf).withColumn("dedupe_minutes", F.lit(0))
    return ordered_rules.suppress_alerts(rows).select("evaluation_id", "delivery_state", "last_sent_us")


@query("dedupe_suppress")
def dedupe_suppress(spark, sf):
    return ordered_rules.suppress_alerts(_triggered(spark, sf)).select("evaluation_id", "delivery_state", "last_sent_us")


@query("rate_limit_audit")
def rate_limit_audit(spark, sf):
    made = ordered_rules.rate_limit(shape(spark, sf, "requests"), "key", "at", "request_id", 2, DAY_US)
    return made.select("request_id", "key", "allowed", "remaining")


@query("dense_position")
def dense_position(spark, sf):
    return shape(spark, sf, "raw_transactions").select(
        "slot", F.posexplode("instructions").alias("instruction_index", "instruction")
    ).select("slot", "instruction_index", F.col("instruction.program_id_index").alias("program_id_index"))


# --- sorts, limits, pages ----------------------------------------------------


@query("registry_page")
def registry_page(spark, sf):
    newest = [F.desc("updated_at"), F.col("program_id")]
    return history.page(inputs.registry(spark, sf), newest, 700, 10).select("program_id", us("updated_at"))


@query("monitor_page")
def monitor_page(spark, sf):
    newest = [F.desc("updated_at"), F.col("monitor_id")]
    visible = history.visible_rows(_monitors(spark, sf), "read", ["Prog1", "Prog4"])
    return history.page(visible, newest, 0, 0).select("monitor_id", "program_id", us("updated_at"))


@query("routes_by_created")
def routes_by_created(spark, sf):
    return shape(spark, sf, "route_requests").orderBy(F.desc("created_at"), "route_id").select("route_id", us("created_at"))


@query("audit_page")
def audit_page(spark, sf):
    newest = [F.desc("evaluated_at"), F.desc("evaluation_id")]
    return history.page(_audit(spark, sf), newest, 120, 30).select("evaluation_id", "monitor_id", us("evaluated_at"))


@query("inbound_page")
def inbound_page(spark, sf):
    landed = ib.inbound_rows(ib.verify_requests(inputs.inbound(spark, sf), SECRET, KEY_ID))
    newest = [F.desc("received_at"), F.desc("request_id")]
    return history.page(landed, newest, 40, 0).select("request_id", "nonce", us("received_at"))


@query("capped_query")
def capped_query(spark, sf):
    return guard.guarded_query(
        spark, "SELECT event_id, program_id, slot FROM chain_events ORDER BY slot DESC, event_id", _tables(spark, sf), 5000
    )


# --- validation and maintenance ----------------------------------------------


@query("validate_launches")
def validate_launches(spark, sf):
    made = history.valid_launches(shape(spark, sf, "launch_requests"))
    return made.select("launch_idx", "name", "program_id", us("launch_ts"), "reject_reason")


@query("validate_monitors")
def validate_monitors(spark, sf):
    made = mon.validate_monitors(shape(spark, sf, "monitor_requests"))
    return made.select("monitor_id", "name", "program_id", "comparator", *mon.DEFAULTS, "reject_reason")


def _changes(spark, sf):
    base = inputs.table(spark, sf, "customer")
    return base.selectExpr(
        "c_custkey + 1 AS monitor_id",
        "CASE c_custkey % 5 WHEN 0 THEN concat(' new ', c_name, ' ') WHEN 1 THEN ' ' END AS name",
        "CASE c_custkey % 4 WHEN 0 THEN 'GTE' WHEN 1 THEN 'between' END AS comparator",
        "CASE WHEN c_custkey % 2 = 0 THEN 7.5D END AS threshold",
        "CASE WHEN c_custkey % 7 = 0 THEN cast(0 AS int) WHEN c_custkey % 7 = 1 THEN cast(30000 AS int) END AS window_minutes",
        "CASE WHEN c_custkey % 11 = 0 THEN false END AS is_active",
    )


@query("patch_monitors")
def patch_monitors(spark, sf):
    made = mon.patch_monitors(_monitors(spark, sf), _changes(spark, sf))
    return made.select("monitor_id", "name", "comparator", "threshold", "window_minutes", "is_active", "reject_reason")


def _registry_changes(spark, sf):
    return inputs.table(spark, sf, "supplier").selectExpr(
        "concat(CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE ' part' END, s_suppkey) AS program_id",
        "element_at(array('create', 'update', 'delete', 'update'), 1 + cast(s_suppkey % 4 AS int)) AS action",
        "CASE WHEN s_suppkey % 5 < 3 THEN concat(' ', s_name) ELSE ' ' END AS name",
        "CASE s_suppkey % 7 WHEN 0 THEN '{oops' WHEN 1 THEN '' WHEN 2 THEN NULL"
        " ELSE concat('{\"name\":\"', s_suppkey, '\"}') END AS content",
    )


@query("registry_merge")
def registry_merge(spark, sf):
    merged = reg.merge_registry(inputs.registry(spark, sf), _registry_changes(spark, sf), NOW)
    return merged.select("program_id", "name", "content", "result", "was_known")


@query("registry_snapshot")
def registry_snapshot(spark, sf):
    merged = reg.merge_registry(inputs.registry(spark, sf), _registry_changes(spark, sf), NOW)
    written = event_log.rewrite(reg.snapshot(merged), workspace(spark, "registry"))
    return written.select("program_id", "name", "content", us("updated_at"))


@query("validate_routes")
def validate_routes(spark, sf):
    return reg.validate_routes(shape(spark, sf, "route_requests"))


@query("purge_audit")
def purge_audit(spark, sf):
    """Kept and purged counts of a purge of the log by day."""
    path = workspace(spark, "audit")
    event_log.append_audit(_audit(spark, sf), path)
    event_log.purge_audit(spark, path, NOW, 240)
    kept = event_log.read_audit(spark, path)
    before = _audit(spark, sf).agg(F.count("*").alias("n")).withColumn("kind", F.lit("before"))
    after = kept.agg(F.count("*").alias("n")).withColumn("kind", F.lit("kept"))
    n = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    return before.unionByName(after).agg(n("kept").alias("kept"), (n("before") - n("kept")).alias("purged"))


@query("purge_nonces")
def purge_nonces(spark, sf):
    rows = inputs.table(spark, sf, "events").select(
        "event_id", (F.floor(timing.micros(F.col("ts")) / 1_000_000) * 1_000_000 + 600_000_000).alias("expires_us")
    )
    return ib.live_nonces(rows, 1705276800000000)


@query("verify_inbound")
def verify_inbound(spark, sf):
    made = ib.verify_requests(inputs.inbound(spark, sf), SECRET, KEY_ID)
    return made.select("request_id", us("received_at"), "reject_reason")


@query("accept_inbound")
def accept_inbound(spark, sf):
    made = ib.accept_requests(ib.verify_requests(inputs.inbound(spark, sf), SECRET, KEY_ID))
    return made.select("request_id", "nonce", "fresh")


# --- scalar functions over whole tables --------------------------------------


@query("growth_ratios")
def growth_ratios(spark, sf):
    """Ratio of each user's events in the second half of the month to the first."""
    late = F.col("timestamp") >= history.utc_bound("2024-01-16T00:00:00Z")
    per = _events(spark, sf).groupBy(F.coalesce("signature", F.lit("")).alias("signer")).agg(
        F.count_if(~late).alias("before"), F.count_if(late).alias("after")
    )
    return per.select("signer", scoring.growth_ratio(F.col("before"), F.col("after")).alias("ratio"))


@query("probability_bands")
def probability_bands(spark, sf):
    p = scoring.clamp((F.col("event_id") % 120) / F.lit(100.0) - F.lit(0.05), 0.01, 0.99)
    return inputs.table(spark, sf, "events").select("event_id", p.alias("p"), scoring.probability_band(p).alias("band"))


@query("report_verdicts")
def report_verdicts(spark, sf):
    ask = F.element_at(F.array(F.lit("Did usage Drop?"), F.lit("signup spike"), F.lit("any decline")), (F.col("event_id") % 3 + 1).cast("int"))
    rows, kpis, lead = F.col("event_id") % 7, F.col("event_id") % 4, (F.col("event_id") % 25) - 3
    return inputs.table(spark, sf, "events").select(
        "event_id",
        scoring.report_verdict(ask, rows, kpis, lead).alias("verdict"),
        scoring.report_confidence(rows, kpis).alias("confidence"),
        scoring.suggested_comparator(ask).alias("comparator"),
        scoring.suggested_threshold(ask, F.when(rows > 0, lead.cast("double"))).alias("threshold_hint"),
    )


@query("sql_hashes")
def sql_hashes(spark, sf):
    return shape(spark, sf, "query_texts").select("doc_id", signing.sql_hash(F.col("sql_text")).alias("sql_hash"))


@query("request_signatures")
def request_signatures(spark, sf):
    rows = inputs.table(spark, sf, "documents")
    made = signing.request_signature(SECRET, F.col("n_chars").cast("string"), F.concat(F.lit("n"), "doc_id"), F.col("text"))
    return rows.select("doc_id", made.alias("signature"))


@query("dedupe_keys")
def dedupe_keys(spark, sf):
    rows = _audit(spark, sf)
    key = signing.dedupe_key(F.col("monitor_id"), F.col("reason"), F.col("comparator"), F.col("query"), F.col("threshold"), F.col("value"))
    return rows.select("evaluation_id", key.alias("dedupe_key"))


@query("event_keys")
def event_keys(spark, sf):
    tx, acc = shape(spark, sf, "raw_transactions"), shape(spark, sf, "raw_accounts")
    left = tx.select(
        identity.transaction_event_id(F.col("signature"), F.col("slot"), F.lit(0)).alias("event_id"),
        identity.partition_key(F.col("signature"), F.col("account_keys")[0]).alias("partition_key"),
    )
    right = acc.select(
        identity.account_event_id(F.col("slot"), F.col("pubkey")).alias("event_id"),
        identity.partition_key(F.col("signature"), F.col("pubkey")).alias("partition_key"),
    )
    return left.unionByName(right)


@query("plain_base64")
def plain_base64(spark, sf):
    rows = inputs.table(spark, sf, "documents")
    return rows.select("doc_id", F.sha2(signing.plain_base64(F.encode("text", "UTF-8")), 256).alias("encoded_hash"))


@query("numeric_texts")
def numeric_texts(spark, sf):
    """Values written in several ways, read back as numbers."""
    v = F.col("value").cast("string")
    ways = [F.concat(F.lit(" "), v), F.concat(v, F.lit("d")), F.concat(F.lit("+"), v), F.concat(v, F.lit("e2")),
            F.lit(""), F.concat(F.lit("."), F.col("event_id").cast("string")), F.lit("1e999"), F.lit("0x1f")]
    texts = inputs.table(spark, sf, "events").select(
        "event_id", F.element_at(F.array(*ways), (F.col("event_id") % len(ways) + 1).cast("int")).alias("given")
    )
    return texts.select("event_id", text.to_double(F.col("given")).alias("number"))


@query("webhook_times")
def webhook_times(spark, sf):
    rows = shape(spark, sf, "launch_requests")
    mixed = F.when(F.col("launch_idx") % 2 == 0, F.concat(F.lit(" "), (F.col("launch_idx") * 86400 - 500).cast("string"))).otherwise(F.col("launch_at"))
    at = timing.parse_unix_or_rfc3339(mixed)
    return rows.select("launch_idx", F.unix_micros(at).alias("at_us"), timing.rfc3339(at).alias("at_text"))


@query("rendered_templates")
def rendered_templates(spark, sf):
    rows = shape(spark, sf, "monitor_requests")
    made = mon.render_template(
        F.col("query_template"), F.concat(F.col("program_id"), F.lit("'x")), F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T00:00:00Z")
    )
    return rows.select("monitor_id", made.alias("sql_text"))


@query("json_validity")
def json_validity(spark, sf):
    rows = shape(spark, sf, "inbound_unsigned")
    return rows.select("request_id", F.coalesce(text.is_json(F.col("body")), F.lit(False)).alias("is_json"))


# --- composite queries -------------------------------------------------------

GUARDED_TEXT = (
    "```sql\nSELECT program_id, count(*) AS events, max(slot) AS slot FROM chain_events "
    "GROUP BY program_id ORDER BY program_id FORMAT JSONEachRow\n```"
)


@query("guarded_sql")
def guarded_sql(spark, sf):
    return guard.guarded_query(spark, GUARDED_TEXT, _tables(spark, sf), 0)


@query("subject_answers")
def subject_answers(spark, sf):
    """One text, run for three subjects over the tables as each may see them."""
    text = "SELECT program_id, count(*) AS events, max(slot) AS slot FROM chain_events GROUP BY program_id"
    made = [
        guard.guarded_query(spark, text, guard.subject_tables(_tables(spark, sf), shape(spark, sf, "grants"), name)).withColumn("subject", F.lit(name))
        for name in ("subject2", "subject4", "nobody")
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("refused_texts")
def refused_texts(spark, sf):
    """Why each distinct monitor text may not run over the event log; NULL where it may."""
    texts = shape(spark, sf, "varied_requests").groupBy("query_template").agg(F.count("*").alias("monitors"))
    rows = [(r["query_template"], r["monitors"]) for r in texts.collect()]  # eleven
    told = [(t, n, guard.plan_reason(spark, t.replace("{{program_id}}", "x"), ["chain_events"])) for t, n in rows]
    return spark.createDataFrame(told, "query_template string, monitors long, reason string")


@query("verified_answer")
def verified_answer(spark, sf):
    made = guard.verified_answer(spark, "signup spike", GUARDED_TEXT, _tables(spark, sf), "chain_events", 0, NOW)
    return made.select(
        "row_count", "row_limit", "verified_answer", "suggested_comparator", "threshold_hint", "sql_hash_sha256",
        F.concat_ws("|", "program_ids").alias("program_ids"), F.concat_ws("|", "slots").alias("slots"),
        F.size("signatures").alias("signature_count"), F.size("sample_rows").alias("sample_count"),
    )


@query("analyst_report")
def analyst_report(spark, sf):
    made = guard.verified_answer(spark, "did activity drop", GUARDED_TEXT, _tables(spark, sf), "chain_events", 0, NOW, report=True)
    return made.select(
        "verdict", "confidence", "executive_summary", "row_count",
        F.concat_ws("|", F.transform("kpis", lambda k: k["metric"])).alias("kpi_names"),
        F.col("kpis")[0]["value"].alias("first_kpi"), F.col("findings")[2].alias("finding"),
        "report_version", F.col("recommended_actions")[0].alias("action"),
        F.col("recommended_automation.comparator").alias("comparator"),
        F.col("recommended_automation.threshold_hint").alias("threshold_hint"),
        F.col("recommended_automation.schedule_minutes").alias("schedule_minutes"),
        F.concat_ws("|", "verification.checks").alias("checks"),
    )


def _evaluated(spark, sf):
    monitors = _monitors(spark, sf).where("is_active")
    return mon.evaluate(_events(spark, sf), monitors, _audit(spark, sf), NOW)


@query("monitor_evaluation")
def monitor_evaluation(spark, sf):
    return _evaluated(spark, sf).select("monitor_id", "value", "triggered", "dedupe_key", "delivery_state", "reason", "query")


@query("template_evaluation")
def template_evaluation(spark, sf):
    """Monitors of many texts, some of which fail, each by its own text."""
    monitors = mon.accepted_monitors(shape(spark, sf, "varied_requests")).where("is_active")
    made = mon.evaluate(_events(spark, sf), monitors, _audit(spark, sf), NOW)
    return made.select("monitor_id", "value", "triggered", "dedupe_key", "delivery_state", F.substring_index("error", ":", 1).alias("failure"))


@query("delivery_outbox")
def delivery_outbox(spark, sf):
    made = mon.alert_outbox(_evaluated(spark, sf), NOW_S, SECRET, KEY_ID)
    return made.select("monitor_id", "url", "sent_at", "nonce", "key_id", "max_attempts", "body", "signature")


@query("event_outbox")
def event_outbox(spark, sf):
    events = _transactions(spark, sf)
    matched = fanout.matched_routes(events, _routes(spark, sf).withColumn("program_id", F.concat(F.lit("part"), "route_id")), STATIC_URL, True)
    made = fanout.event_outbox(matched, "chain event", NOW_S, SECRET, KEY_ID, 3)
    return made.select("event_id", "route_id", "url", F.sha2("body", 256).alias("body_hash"), "signature", "max_attempts")
