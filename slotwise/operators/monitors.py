"""Metric monitors: validation, evaluation, delivery decisions, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import threshold_met
from ..functions.signing import dedupe_key
from ..functions.text import bind, is_base58, is_http_url, strip
from ..functions.timing import minutes_or, minutes_us, rfc3339
from ..session import workspace
from .guard import clean_sql, reject_reason
from .history import utc_bound
from .templates import recognised, template_values

# Defaults and caps of monitor settings.
DEFAULTS = {
    "schedule_minutes": 60,
    "window_minutes": 60,
    "cooldown_minutes": 30,
    "dedupe_minutes": 15,
    "retry_max_attempts": 3,
    "retry_initial_backoff_ms": 200,
}
CAPS = {
    "window_minutes": 20160,
    "dedupe_minutes": 20160,
    "retry_max_attempts": 10,
    "retry_initial_backoff_ms": 30000,
}
_TEXT = ("name", "program_id", "query_template", "webhook_url")


def render_template(template: Column, program_id: Column, start: Column, end: Column) -> Column:
    """Fill the place holders; quotes in the program id are doubled."""
    text = F.replace(
        strip(template), F.lit("{{program_id}}"), F.replace(program_id, F.lit("'"), F.lit("''"))
    )
    text = F.replace(text, F.lit("{{from}}"), start)
    return F.replace(text, F.lit("{{to}}"), end)


def normalized_monitors(requests: DataFrame) -> DataFrame:
    """Trimmed settings with defaults filled in."""
    comparator = F.lower(strip(F.col("comparator")))
    made = requests.withColumns({c: strip(F.col(c)) for c in _TEXT})
    made = made.withColumn("comparator", F.when(F.coalesce(comparator, F.lit("")) == "", "lt").otherwise(comparator))
    return made.withColumns({c: minutes_or(F.col(c), d) for c, d in DEFAULTS.items()})


def validate_monitors(requests: DataFrame) -> DataFrame:
    """Normalised monitors with their first complaint, NULL when accepted."""
    made = normalized_monitors(requests)
    stamp = F.lit("2000-01-01T00:00:00Z")
    rendered = render_template(F.col("query_template"), F.coalesce("program_id", F.lit("")), stamp, stamp)
    unsafe = bind(clean_sql(rendered), reject_reason)

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    reason = (
        F.when(blank("name"), "name is required")
        .when(blank("query_template"), "query_template is required")
        .when(
            ~F.col("comparator").isin("gt", "gte", "lt", "lte"), "comparator must be one of: gt, gte, lt, lte"
        )
        .when(~blank("program_id") & ~is_base58(F.col("program_id")), "program_id must be base58")
        .when(blank("webhook_url"), "webhook_url is required")
        .when(~is_http_url(F.col("webhook_url")), "webhook_url is invalid")
    )
    for name, cap in CAPS.items():
        reason = reason.when(F.col(name) > cap, f"{name} cannot exceed {cap}")
    reason = F.coalesce(reason, F.concat(F.lit("query_template is invalid: "), unsafe))
    return made.withColumn("reject_reason", reason)


def accepted_monitors(requests: DataFrame) -> DataFrame:
    return validate_monitors(requests).where("reject_reason IS NULL").drop("reject_reason")


def patch_monitors(monitors: DataFrame, changes: DataFrame, key: str = "monitor_id") -> DataFrame:
    """Apply the supplied fields of a change feed, then validate again.

    A supplied text that is blank is a complaint of its own; NULL means absent. Several
    changes of one monitor have no order among them: none is applied, which is a complaint.
    """
    supplied = [c for c in changes.columns if c != key]
    only = F.count("*") == 1
    renamed = changes.groupBy(key).agg(
        *[F.when(only, F.any_value(c)).alias(f"_new_{c}") for c in supplied], (~only).alias("_conflict")
    )
    joined = monitors.join(renamed, key, "left")
    patched = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in supplied})
    blank = F.lit(None).cast("string")
    for c in ("name", "query_template", "webhook_url"):
        if c in supplied:
            blank = F.when(strip(F.col(f"_new_{c}")) == "", f"{c} cannot be empty").otherwise(blank)
    if "comparator" in supplied:
        blank = F.when(
            strip(F.col("_new_comparator")) == "", "comparator must be one of: gt, gte, lt, lte"
        ).otherwise(blank)
    blank = F.when(F.col("_conflict"), "several changes of one monitor").otherwise(blank)
    checked = validate_monitors(patched.withColumn("_blank", blank))
    return checked.withColumn("reject_reason", F.coalesce("_blank", "reject_reason")).drop(
        "_blank", "_conflict", *[f"_new_{c}" for c in supplied]
    )


def last_state(audit: DataFrame) -> DataFrame:
    """Last evaluation and last alert of each monitor, from its audit rows.

    An alert still ``queued`` counts as sent until its delivery has failed, so a tick
    before the consumer's report does not hand it over again.
    """
    place = F.struct("evaluated_at", "evaluation_id")
    sent = F.when(F.col("alert_sent") | (F.col("delivery_state") == "queued"), place)
    return audit.groupBy("monitor_id").agg(
        F.max("evaluated_at").alias("last_evaluated_at"),
        F.max_by("value", place).alias("last_value"),
        F.max(sent)["evaluated_at"].alias("last_triggered_at"),
        F.max_by("dedupe_key", sent).alias("last_fingerprint"),
    )


def monitor_values(events: DataFrame, monitors: DataFrame, now: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """``value`` and ``error`` of every monitor's own text over [now - window, now).

    Texts of the plain counting forms share one pass over the events; every other text is a plan of
    its own for all its monitors. Texts read ``chain_events``, in which a missing signature is
    an empty text, and the ``tables`` given.
    """
    # The guard reads the rendered text, program included; a text it refuses is not counted either.
    stamp = F.lit("2000-01-01T00:00:00Z")
    rendered = render_template(F.col("query_template"), F.coalesce("program_id", F.lit("")), stamp, stamp)
    unsafe = bind(clean_sql(rendered), reject_reason)
    shared = monitors.withColumn("_count", F.when(unsafe.isNull(), recognised(F.col("query_template"))))
    # Written once: the monitors' checks cost more than all that follows, which reads them four times.
    path = workspace(events.sparkSession, "monitors")
    shared.write.parquet(path)
    shared = events.sparkSession.read.schema(shared.schema).parquet(path)
    counted = counted_values(events, shared.where("_count IS NOT NULL"), now).withColumn("error", F.lit(""))
    others = shared.where("_count IS NULL")
    if others.isEmpty():
        return counted.drop("_count")
    read = {"chain_events": events.withColumn("signature", F.coalesce("signature", F.lit("")))} | (tables or {})
    return counted.unionByName(template_values(others, now, read)).drop("_count")


def counted_values(events: DataFrame, monitors: DataFrame, now: str) -> DataFrame:
    """Values of monitors by their ``_count`` over [now - window, now), every monitor in one pass.

    All windows end at the same instant and span whole minutes, so the events
    reduce to counts per (program, minute of age) and a window is a running sum
    up to its length. A signer counts in a window from its smallest age on.
    Monitors join on (program, window length): an event meets no monitor at all.
    """
    end = utc_bound(now)
    longest = monitors.agg(F.max("window_minutes").alias("m")).first()["m"] or 0
    start = end - F.expr(f"INTERVAL {int(longest)} MINUTE")
    age_us = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))
    minute = F.ceil(age_us / F.lit(60_000_000)).cast("int")
    recent = events.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select(
        "program_id", minute.alias("minute"), F.coalesce("signature", F.lit("")).alias("signature"), "event_type"
    )
    sent = F.col("event_type") == "transaction"
    # One shuffle on (program, signer, minute) feeds both counts.
    cells = recent.groupBy("program_id", "signature", "minute").agg(
        F.count("*").alias("events"), F.count_if(sent).alias("transactions")
    )
    counts = cells.groupBy("program_id", "minute").agg(
        F.sum("events").alias("events"), F.sum("transactions").alias("transactions"), F.lit(0).alias("signers")
    )
    signers = (
        cells.groupBy("program_id", "signature")
        .agg(F.min("minute").alias("minute"))
        .groupBy("program_id", "minute")
        .agg(F.lit(0).alias("events"), F.lit(0).alias("transactions"), F.count("*").alias("signers"))
    )
    asked = monitors.select("program_id", F.col("window_minutes").alias("minute")).distinct()
    zero = F.lit(0).cast("bigint")
    probes = asked.select(
        "program_id", "minute", zero.alias("events"), zero.alias("transactions"), zero.alias("signers"),
        F.lit(True).alias("probe"),
    )
    steps = counts.unionByName(signers).withColumn("probe", F.lit(False)).unionByName(probes)
    # At most one window length per row and 20,160 minutes per program.
    upto = W.partitionBy("program_id").orderBy("minute").rangeBetween(W.unboundedPreceding, W.currentRow)
    running = steps.select(
        "program_id", "minute", "probe", *[F.sum(c).over(upto).alias(c) for c in ("events", "transactions", "signers")]
    ).where("probe")
    values = running.select(
        "program_id",
        F.col("minute").alias("window_minutes"),
        *[F.col(c).cast("double").alias(f"_{c}") for c in ("events", "transactions", "signers")],
    )
    value = F.when(F.col("_count") == "events", F.col("_events"))
    value = value.when(F.col("_count") == "transactions", F.col("_transactions")).otherwise(F.col("_signers"))
    made = monitors.join(values, ["program_id", "window_minutes"], "left").withColumn("value", value)
    return made.select(*monitors.columns, "value")


def evaluate(
    events: DataFrame, monitors: DataFrame, audit: DataFrame, now: str, send: bool = True,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Evaluate monitors at ``now``, each by its own text, and decide on delivery.

    A deliverable alert is ``queued``: it becomes ``sent`` or ``failed`` with the outbox
    consumer's report (:func:`settle`).
    """
    end = utc_bound(now)
    valued = monitor_values(events, monitors, now, tables).join(
        last_state(audit.where(F.col("evaluated_at") < end)).drop("last_value"), "monitor_id", "left"
    )
    start = end - F.make_dt_interval(mins=F.col("window_minutes"))
    rendered = render_template(F.col("query_template"), F.col("program_id"), rfc3339(start), rfc3339(end))
    key = dedupe_key(
        F.col("monitor_id"), F.col("program_id"), F.col("comparator"), F.col("query_template"),
        F.col("threshold"), F.col("value"),
    )
    triggered = threshold_met(F.col("value"), F.col("comparator"), F.col("threshold"))
    age = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("last_triggered_at").cast("timestamp"))
    cooling = F.coalesce((F.col("cooldown_minutes") > 0) & (age < minutes_us(F.col("cooldown_minutes"))), F.lit(False))
    repeated = F.coalesce(
        (F.col("dedupe_minutes") > 0)
        & (strip(F.col("last_fingerprint")) != "")
        & (F.col("last_fingerprint") == F.col("dedupe_key"))
        & (age < minutes_us(F.col("dedupe_minutes"))),
        F.lit(False),
    )
    failed = F.col("triggered").isNull()
    state = (
        F.when(failed, "evaluation_failed")
        .when(~F.col("triggered"), "not_triggered")
        .when(F.col("dry_run"), "dry_run")
        .when(F.lit(not send), "disabled")
        .when(cooling, "cooldown")
        .when(repeated, "deduped")
        .otherwise("queued")
    )
    # The reason recorded with each state.
    reasons = {
        "evaluation_failed": "automation evaluation failed before delivery",
        "not_triggered": "condition not met",
        "dry_run": "triggered in dry-run mode (no webhook sent)",
        "disabled": "triggered but webhook delivery disabled for this run",
        "cooldown": "triggered but still in cooldown",
        "deduped": "triggered but dedupe window suppressed duplicate alert",
    }
    reason = F.lit("triggered and handed to delivery")
    for name, sentence in reasons.items():
        reason = F.when(F.col("delivery_state") == name, sentence).otherwise(reason)
    return (
        valued.withColumn("triggered", triggered)
        .withColumn("dedupe_key", F.when(F.col("triggered"), key))
        .withColumn("delivery_state", state)
        .withColumn("reason", reason)
        .withColumn("query", F.when(F.col("triggered").isNull(), F.col("query_template")).otherwise(rendered))
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .withColumn("window_from", F.when(F.col("triggered").isNull(), end).otherwise(start))
        .withColumn("window_to", end)
        .withColumn("evaluated_at", end)
        .withColumn("triggered", F.coalesce("triggered", F.lit(False)))
    )


def audit_rows(evaluations: DataFrame) -> DataFrame:
    """Evaluations in the shape of the audit log."""
    return evaluations.select(
        F.xxhash64("monitor_id", "evaluated_at").alias("evaluation_id"),
        "monitor_id", "value", "threshold", "comparator", "triggered",
        (F.col("delivery_state") == "sent").alias("alert_sent"),
        "delivery_state", "reason", "query", "window_from", "window_to", "evaluated_at", "dry_run",
        F.coalesce("dedupe_key", F.lit("")).alias("dedupe_key"),
        F.lit(0).alias("retry_attempts"), "error",
        F.col("evaluated_at").alias("created_at"),
    )


def settle(audit: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Audit rows after the consumer's reports (evaluation_id, delivered, retry_attempts, error).

    A queued row becomes ``sent`` or ``failed``; of several reports on one row the one
    with most attempts counts. Rows without a report, and rows not queued, stay.
    """
    last = outcomes.groupBy("evaluation_id").agg(
        F.max(F.struct(F.col("retry_attempts").cast("int").alias("attempts"), "delivered", "error")).alias("_last")
    )
    joined = audit.join(last, "evaluation_id", "left")
    told = (F.col("delivery_state") == "queued") & F.col("_last.delivered").isNotNull()
    sent = told & F.col("_last.delivered")
    failed = told & ~F.col("_last.delivered")
    # The reason recorded with each outcome.
    changes = {
        "alert_sent": F.when(told, F.col("_last.delivered")),
        "delivery_state": F.when(sent, "sent").when(failed, "failed"),
        "reason": F.when(sent, "triggered and webhook sent").when(failed, "triggered but webhook delivery failed after retries"),
        "retry_attempts": F.when(told, F.col("_last.attempts")),
        "error": F.when(failed, F.coalesce("_last.error", F.lit(""))),
    }
    return joined.select(*[F.coalesce(changes[c], F.col(c)).alias(c) if c in changes else F.col(c) for c in audit.columns])


def audit_for_monitor(audit: DataFrame, monitors: DataFrame, monitor_id: int) -> DataFrame:
    known = monitors.where(F.col("monitor_id") == monitor_id).select("monitor_id")
    return audit.where(F.col("monitor_id") == monitor_id).join(known, "monitor_id", "left_semi")


def orphan_audit(audit: DataFrame, monitors: DataFrame) -> DataFrame:
    return audit.join(monitors.select("monitor_id"), "monitor_id", "left_anti")


def kept_audit(audit: DataFrame, now: str, retention_hours: int = 720) -> DataFrame:
    """Audit rows that survive a purge."""
    return audit.where(F.col("created_at") >= retention_edge(now, retention_hours))


def retention_edge(now: str, retention_hours: int) -> Column:
    return utc_bound(now) - F.expr(f"INTERVAL {int(retention_hours)} HOUR")


def alert_outbox(evaluations: DataFrame, now_unix_s: int, secret: str, key_id: str) -> DataFrame:
    """Signed deliveries of queued alerts, for a consumer to post."""
    from .fanout import signed_rows

    body = F.to_json(
        F.struct(
            F.lit("agent_automation_triggered").alias("event"),
            F.col("monitor_id").alias("automation_id"),
            "name", "program_id", "value", "threshold", "comparator", "triggered", "query",
            rfc3339(F.col("window_from")).alias("window_from"),
            rfc3339(F.col("window_to")).alias("window_to"),
            rfc3339(F.col("evaluated_at")).alias("evaluated_at"),
            "delivery_state", "dry_run", "dedupe_key",
            F.lit(0).alias("retry_attempts"),
        )
    )
    queued = evaluations.where("delivery_state = 'queued'")
    rows = queued.select(
        "monitor_id", F.col("webhook_url").alias("url"), body.alias("body"),
        F.sha2(F.concat_ws("|", "monitor_id", "dedupe_key", F.lit(str(now_unix_s))), 256).alias("nonce"),
        F.least("retry_max_attempts", F.lit(CAPS["retry_max_attempts"])).alias("_attempts"),
    )
    return signed_rows(rows, now_unix_s, secret, key_id, F.col("_attempts")).drop("_attempts")
