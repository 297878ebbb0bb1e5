"""Registered streaming queries: each runs its stream over the whole tables, then reads the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import timing
from ..operators import history
from ..operators import monitors as mon
from ..operators import normalize as norm
from ..operators import ordered_rules
from ..session import workspace
from ..sources import event_log
from ..streaming import ingest
from ..streaming import windows
from ..streaming.keyed import streamed
from . import catalog, inputs
from .catalog import DAY_US, NOW, STATIC_URL, query, us
from .inputs import shape


#: Rows of the registered streams arrive up to so long after their time, in so many deliveries.
DELAY_MS, DELIVERIES = 6 * 3_600_000, 3


def _decided(spark: SparkSession, sf_dir: str, columns, purpose: str):
    """The events table delivered as a running source would: rows come up to DELAY_MS late, in deliveries of
    arrival time. After each the stream goes on from its checkpoint and decides what the watermark has passed.

    ``columns`` makes the decisions' stream of the table's stream. The last delivery is one row of a
    year later, as a source sends that wants what waits to be decided. Its own key never is.
    """
    path = workspace(spark, purpose)
    table = inputs.table(spark, sf_dir, "events")
    arrival = F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(DELAY_MS))
    low, high = table.select(arrival.alias("a")).agg(F.min("a"), F.max("a")).first()
    width = (high - low) // DELIVERIES + 1
    last = table.limit(1).withColumns({
        "event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "value": F.lit(1e9), "ts": F.lit(high / 1000 + 366 * 86400).cast("timestamp").cast("timestamp_ntz"),
    })
    deliveries = [table.where((arrival >= low + i * width) & (arrival < low + (i + 1) * width)) for i in range(DELIVERIES)]
    for rows in [*deliveries, last]:
        rows.write.mode("append").parquet(f"{path}/source")
        stream = spark.readStream.schema(schemas.TABLES["events"]).parquet(f"{path}/source")
        made = columns(stream, streamed(DELAY_MS))
        ingest.append_available(made, f"{path}/decided", f"{path}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{path}/decided")


def _landed(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    path = workspace(spark, purpose)
    ingest.append_available(stream, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "updates")
    ingest.update_lines(shape(spark, sf_dir, "raw_transactions"), shape(spark, sf_dir, "raw_accounts")).write.text(path)
    return ingest.file_updates(spark, path, files_per_batch=4)


def _ingested(spark: SparkSession, sf_dir: str, sink: str, schema, routes: bool = False, publish=ingest.accepted_by_topic):
    path = workspace(spark, "ingest")
    job = ingest.Ingest(
        lambda: inputs.registry(spark, sf_dir),
        (lambda: shape(spark, sf_dir, "routes").withColumn("program_id", F.concat(F.lit("part"), "route_id"))) if routes else None,
        path,
        STATIC_URL,
        publish,
    )
    ingest.run_available(_updates(spark, sf_dir), job, f"{path}/checkpoint")
    if schema is None:
        return f"{path}/{sink}"
    return spark.read.schema(schema).parquet(f"{path}/{sink}")


@query("stream_updates")
def stream_updates(spark, sf):
    landed = _landed(spark, _updates(spark, sf), "raw")
    return landed.select(
        F.when(F.col("transaction").isNotNull(), "transaction").otherwise("account").alias("kind"),
        F.coalesce("transaction.slot", "account.slot").alias("slot"),
        F.coalesce("transaction.signature", "account.signature").alias("signature"),
    )


@query("stream_normalize")
def stream_normalize(spark, sf):
    return _ingested(spark, sf, "normalized", schemas.NORMALIZED_EVENT).select(*schemas.NORMALIZED_EVENT.names)


def _failing_topic(records):
    return records.withColumn("error", F.when(F.col("slot") % 10 == 1, "topic unavailable"))


@query("stream_publish_dlq")
def stream_publish_dlq(spark, sf):
    """Published and dead-lettered events when the topic fails for some slots."""
    from ..sources.json_rows import read_dead_letters

    path = _ingested(spark, sf, "", None, publish=_failing_topic)
    topic = spark.read.schema("key string, value string").parquet(f"{path}topic")
    letters = read_dead_letters(spark, f"{path}dead_letters")
    return topic.select(F.get_json_object("value", "$.event_id").alias("event_id"), F.lit("published").alias("state")).unionByName(
        letters.select("event.event_id", F.concat(F.lit("dead_letter: "), "error").alias("state"))
    )


@query("stream_ingest_metrics")
def stream_ingest_metrics(spark, sf):
    path = _ingested(spark, sf, "metrics", None)
    rows = spark.read.schema(
        "events_total bigint, published_total bigint, publish_failures_total bigint, last_event_observed_ms bigint"
    ).parquet(path)
    return rows.agg(
        F.sum("events_total").alias("events_total"), F.sum("published_total").alias("published_total"),
        F.sum("publish_failures_total").alias("publish_failures_total"),
        F.max("last_event_observed_ms").alias("last_event_observed_ms"),
    )


@query("stream_fanout")
def stream_fanout(spark, sf):
    schema = schemas.T.StructType(
        schemas.NORMALIZED_EVENT.fields
        + [schemas.T.StructField(c, schemas.T.StringType()) for c in ("route_id", "url", "program_id_filter", "event_type_filter", "source")]
    )
    return _ingested(spark, sf, "outbox", schema, routes=True).select("event_id", "route_id", "url", "source")


@query("nonce_replay_filter")
def nonce_replay_filter(spark, sf):
    def fresh(stream, rule):
        received = (F.floor(timing.micros(F.col("ts")) / 1_000_000) * 1_000_000).alias("received_us")
        rows = stream.select("event_id", "user_id", received)
        return ordered_rules.new_nonces(rows, "user_id", "received_us", "event_id", 36_000 * 1_000_000, rule=rule)

    return _decided(spark, sf, fresh, "nonces").select("event_id", "user_id", "fresh")


@query("stream_rate_limit")
def stream_rate_limit(spark, sf):
    def limited(stream, rule):
        rows = stream.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
        return ordered_rules.rate_limit(rows, "key", "at", "request_id", 2, DAY_US, rule=rule)

    return _decided(spark, sf, limited, "limits").select("request_id", "key", "allowed", "remaining")


@query("stream_alert_suppress")
def stream_alert_suppress(spark, sf):
    def suppressed(stream, rule):
        rows = stream.selectExpr(*inputs.AUDIT).where("triggered").select(
            "evaluation_id", "monitor_id", "evaluated_at", "dedupe_key",
            F.lit(1440).alias("cooldown_minutes"), F.lit(7200).alias("dedupe_minutes"),
        )
        return ordered_rules.suppress_alerts(rows, rule=rule)

    return _decided(spark, sf, suppressed, "alerts").select("evaluation_id", "delivery_state", "last_sent_us")


@query("events_per_window")
def events_per_window(spark, sf):
    def counted(stream, rule):
        return windows.events_per_window(stream.selectExpr(*inputs.CHAIN_EVENTS), "6 hours", delay_ms=DELAY_MS)

    return _decided(spark, sf, counted, "windows").select("program_id", us("window_start"), us("window_end"), "events", "transactions")


@query("events_per_session")
def events_per_session(spark, sf):
    def counted(stream, rule):
        return windows.events_per_session(stream.selectExpr(*inputs.CHAIN_EVENTS), "90 minutes", delay_ms=DELAY_MS)

    return _decided(spark, sf, counted, "sessions").select("program_id", us("window_start"), us("window_end"), "events", "transactions")


@query("dlq_replay_job")
def dlq_replay_job(spark, sf):
    path = workspace(spark, "letters")
    catalog._letter_lines(spark, sf).write.text(path)
    publish = lambda batch: batch.where(F.col("event.slot") % 10 != 1)
    return ingest.replay_dead_letters(spark, path, workspace(spark, "letters"), publish, 200)


@query("monitor_tick")
def monitor_tick(spark, sf):
    """Due monitors evaluated at one instant and appended to the audit log."""
    path = workspace(spark, "audit")
    audit = shape(spark, sf, "audit")
    state = mon.last_state(audit.where(F.col("evaluated_at") < history.utc_bound(NOW)))
    due = history.due_monitors(catalog._monitors(spark, sf), state.select("monitor_id", "last_evaluated_at"), NOW)
    made = mon.evaluate(shape(spark, sf, "chain_events"), due.drop("last_evaluated_at"), audit, NOW)
    event_log.append_audit(mon.audit_rows(made), path)
    return event_log.read_audit(spark, path).select("monitor_id", "value", "delivery_state", us("window_from"))


def _kept_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active monitors as a registry holds them: checked when they were accepted, not at each tick again."""
    return event_log.rewrite(catalog._monitors(spark, sf_dir).where("is_active"), workspace(spark, "registered"))


@query("monitor_two_ticks")
def monitor_two_ticks(spark, sf):
    """How often each alert handed over at one tick is handed over by the tick a minute later as well."""
    path = workspace(spark, "audit")
    events, monitors, audit = shape(spark, sf, "chain_events"), _kept_monitors(spark, sf), shape(spark, sf, "audit")
    first = mon.evaluate(events, monitors, audit, NOW)
    event_log.append_audit(mon.audit_rows(first), path)
    log = audit.unionByName(event_log.read_audit(spark, path), allowMissingColumns=True)
    second = mon.evaluate(events, monitors, log, NOW.replace("06:00:00", "06:01:00"))
    handed = mon.audit_rows(second).unionByName(event_log.read_audit(spark, path), allowMissingColumns=True).where("delivery_state = 'queued'")
    made = handed.groupBy("monitor_id").agg(F.min("evaluated_at").alias("since"), F.count("*").alias("deliveries"))
    return made.where(F.col("since") == history.utc_bound(NOW)).select("monitor_id", "deliveries")


#: Instants of three ticks, and what the consumer of alerts reports for a monitor (nothing for every fourth).
TICKS = (NOW, NOW.replace("06:00:00", "06:20:00"), NOW.replace("06:00:00", "06:50:00"))


def _reports(log: DataFrame) -> DataFrame:
    kind = F.col("monitor_id") % 4
    handed = log.where((F.col("delivery_state") == "queued") & (kind != 0))
    return handed.select(
        "evaluation_id", (kind != 1).alias("delivered"), F.when(kind == 1, 3).otherwise(1).alias("retry_attempts"),
        F.when(kind == 1, " webhook returned status 500 ").otherwise("").alias("error"),
    )


@query("monitor_three_ticks")
def monitor_three_ticks(spark, sf):
    """Three ticks, each after the reports on the alerts of the one before: sent, failed and tried again, held back."""
    path = workspace(spark, "ticks")
    events, monitors, audit = shape(spark, sf, "chain_events"), _kept_monitors(spark, sf), shape(spark, sf, "audit")
    log = audit
    for i, now in enumerate(TICKS):
        event_log.append_audit(mon.audit_rows(mon.evaluate(events, monitors, log, now)), f"{path}/told{i}")
        told = event_log.read_audit(spark, f"{path}/told{i}")
        event_log.append_audit(mon.settle(told, _reports(told)), f"{path}/settled")
        log = audit.unionByName(event_log.read_audit(spark, f"{path}/settled"), allowMissingColumns=True)
    return event_log.read_audit(spark, f"{path}/settled").select(
        "monitor_id", us("evaluated_at"), "delivery_state", "alert_sent", "retry_attempts", F.btrim("error").alias("error"), "reason"
    )
