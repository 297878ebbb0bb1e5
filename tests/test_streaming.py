import uuid

from pyspark.sql import functions as F

from slotwise.operators import ordered_rules
from slotwise.plans.inputs import registry, shape, table
from slotwise.schemas import EVENT_LOG
from slotwise.session import workspace
from slotwise.sources.json_rows import read_dead_letters
from slotwise.streaming import ingest, keyed

SF = "/root/testdata/sf0.001"


DAY = 86_400_000_000


def _deliver(spark, rows, parts, apply, delay_ms, flush=True):
    """Rows delivered part by part, each followed by a run of the stream; what had come out after each run, and its state rows."""
    path, seen = workspace(spark, "keyed"), []
    parts = [rows.where(p) if isinstance(p, str) else p for p in parts]
    if flush:  # one row long after all others
        far = F.to_timestamp(F.lit("2031-01-01 00:00:00")).cast("timestamp_ntz")
        parts.append(rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "ts": far}))
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        made = apply(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), keyed.streamed(delay_ms))
        query = made.writeStream.format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation", f"{path}/checkpoint"
        ).trigger(availableNow=True).start()
        query.awaitTermination()
        done = spark.read.schema(made.schema).parquet(f"{path}/out")
        seen.append((done.count(), query.lastProgress.stateOperators[0].numRowsTotal if query.lastProgress else None))
    return done, seen


def _limited(rows, rule=ordered_rules.apply_quiet_rule):
    return ordered_rules.rate_limit(rows, "user_id", "ts", "event_id", 2, DAY, rule=rule)


HOURS = [f"ts >= timestamp_ntz'2024-01-01' + INTERVAL {i * 10} DAY AND ts < timestamp_ntz'2024-01-01' + INTERVAL {i * 10 + 10} DAY" for i in range(3)]


def test_rows_are_decided_while_the_stream_runs(spark):
    rows = table(spark, SF, "events").select("event_id", "user_id", "ts").where("ts < timestamp_ntz'2024-01-31'")
    got, seen = _deliver(spark, rows, HOURS, _limited, 3_600_000)
    want = _limited(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    counts = [n for n, _ in seen]
    assert 0 < counts[0] < counts[1] < counts[2] <= counts[3] == rows.count()


def test_suppression_keeps_marks_across_runs(spark):
    rows = table(spark, SF, "events").select("event_id", "user_id", "ts", "event_type").where("ts < timestamp_ntz'2024-01-31'")

    def suppressed(stream, rule=ordered_rules.apply_quiet_rule):
        return ordered_rules.suppress_alerts(stream.selectExpr(
            "event_id evaluation_id", "CASE WHEN user_id < 0 THEN -1 ELSE user_id % 3 END monitor_id", "ts evaluated_at",
            "event_type dedupe_key", "600 cooldown_minutes", "2000 dedupe_minutes",
        ), rule=rule)

    got, _ = _deliver(spark, rows, HOURS, suppressed, 60_000)
    want = suppressed(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_come_back_undecided(spark):
    rows = table(spark, SF, "events").select("event_id", "user_id", "ts").where("ts < timestamp_ntz'2024-01-31'")
    timeless = rows.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("event_id", F.col("event_id") + 1_000_000)
    got, _ = _deliver(spark, rows, [HOURS[0], HOURS[2], HOURS[1], timeless], _limited, 86_400_000)
    late = got.where("allowed IS NULL")
    assert got.count() == rows.count() + 3
    # What came third lies before the watermark but for the day it allows; so do rows without a time.
    early = rows.where(HOURS[1]).count()
    assert early * 0.8 < late.count() - 3 <= early and late.where("event_id >= 1000000").count() == 3
    on_time = rows.join(late, "event_id", "left_anti")
    decided = got.where("allowed IS NOT NULL")
    assert decided.exceptAll(_limited(on_time)).count() == 0 and decided.count() == on_time.count()


def test_state_shrinks_by_event_time(spark):
    """A key's state goes once its spans have passed, with no row of the key to touch it."""
    hour = "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id AS int))"
    rows = spark.range(400).selectExpr("id event_id", "id user_id", f"{hour} ts")
    done, seen = _deliver(spark, rows, ["true"], _limited, 0)
    # A key an hour with spans of a day: the last day's keys are left, at most three entries each; then the flushing key alone.
    assert done.count() == 400 and 24 <= seen[0][1] <= 80 and seen[1][1] <= 4


def test_odd_columns_and_repeats_pass_through_the_state(spark):
    """Nulls in every column, clashing names, a null key and rows that occur twice."""
    base = table(spark, SF, "events").select("event_id", "user_id", "ts").where("ts < timestamp_ntz'2024-01-05'")
    rows = base.withColumns({
        "user_id": F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 5), "at": F.when(F.col("event_id") % 3 == 0, F.col("event_id") / 7),
        "payload": F.when(F.col("event_id") % 2 == 0, "x\ny"), "k": F.lit(9_007_199_254_740_993),
    })
    rows = rows.unionByName(rows.where("event_id % 10 = 0"))
    got, _ = _deliver(spark, rows, ["true"], _limited, 0)
    want = _limited(rows)
    assert got.schema == want.schema
    key = lambda df: sorted(map(str, df.drop("event_id").where("user_id IS NULL OR user_id >= 0").collect()))
    assert key(got) == key(want)


def test_many_keys_share_a_bucket_of_state(spark, monkeypatch):
    """All keys in two buckets: decisions and what is dropped stay each key's own."""
    monkeypatch.setattr(keyed, "BUCKETS", 2)
    rows = table(spark, SF, "events").select("event_id", "user_id", "ts").where("ts < timestamp_ntz'2024-01-31'")
    rows = rows.withColumn("user_id", F.when(F.col("event_id") % 9 != 0, F.col("user_id")))
    got, seen = _deliver(spark, rows, HOURS[:1] + [f"NOT ({HOURS[0]})"], _limited, 3_600_000)
    want = _limited(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert all(n <= 2 * 5 for _, n in seen)


def _job(spark, out, load):
    return ingest.Ingest(load, lambda: shape(spark, SF, "routes"), out, "https://s/x")


def test_restart_and_registry_failure(spark):
    updates = workspace(spark, "updates")
    lines = ingest.update_lines(shape(spark, SF, "raw_transactions"), shape(spark, SF, "raw_accounts"))
    noise = spark.createDataFrame([('{"slot_status":{}}',), ("nonsense",)], "value string")
    lines.unionByName(noise).repartition(3).write.text(updates)
    out = workspace(spark, "ingest")
    calls = []

    def load():
        calls.append(1)
        good = registry(spark, SF)
        if len(calls) == 2:  # one blank key fails the load; the old copy stays in use
            return good.withColumn("program_id", F.lit(" "))
        return good

    job = _job(spark, out, load)
    stream = ingest.file_updates(spark, updates, files_per_batch=1)
    ingest.run_available(stream, job, f"{out}/checkpoint")
    ingest.run_available(stream, job, f"{out}/checkpoint")  # restart: nothing left to do
    landed = spark.read.schema(EVENT_LOG).parquet(f"{out}/event_log")
    reg = ingest.normalize.load_registry(registry(spark, SF))
    tx = ingest.normalize.normalize_transactions(shape(spark, SF, "raw_transactions"), reg)
    acc = ingest.normalize.normalize_accounts(shape(spark, SF, "raw_accounts"), reg)
    want = ingest.normalize.event_log_rows(tx.unionByName(acc))
    assert len(calls) >= 3
    assert landed.count() == want.count() > 500
    assert landed.select(*EVENT_LOG.names).exceptAll(want).count() == 0
    job(ingest.parse_updates(spark.read.text(updates)), 0)  # a retried batch overwrites its own folder


def test_kept_copy_survives_a_bad_load_in_place(spark):
    source, out = workspace(spark, "registry-source"), workspace(spark, "ingest")
    registry(spark, SF).write.parquet(source)
    job = ingest.Ingest(lambda: spark.read.parquet(source), None, out)
    updates = ingest.parse_updates(
        ingest.update_lines(shape(spark, SF, "raw_transactions").limit(50), shape(spark, SF, "raw_accounts").limit(50))
    )
    job(updates, 0)
    registry(spark, SF).withColumn("program_id", F.lit(" ")).write.mode("overwrite").parquet(source)
    job(updates, 1)
    rows = spark.read.parquet(f"{out}/normalized").groupBy("batch_id").count().collect()
    assert len(rows) == 2 and rows[0]["count"] == rows[1]["count"] > 0


def test_failed_publishing_becomes_dead_letters(spark):
    out, calls = workspace(spark, "ingest"), []

    def publish(records):
        calls.append(1)
        return records.withColumn("error", F.when(F.col("slot") % 2 == 0, "topic unavailable"))

    job = ingest.Ingest(lambda: registry(spark, SF), None, out, publish=publish)
    updates = ingest.parse_updates(
        ingest.update_lines(shape(spark, SF, "raw_transactions").limit(50), shape(spark, SF, "raw_accounts").limit(50))
    )
    job(updates, 0)
    letters = read_dead_letters(spark, f"{out}/dead_letters")
    topic, events = spark.read.parquet(f"{out}/topic"), spark.read.parquet(f"{out}/normalized")
    assert len(calls) == 1 and letters.where("error <> 'topic unavailable'").count() == 0
    assert letters.count() == events.where("slot % 2 = 0").count() > 0
    assert topic.count() == events.where("slot % 2 = 1").count() > 0


def test_replay_publishes_each_letter_once(spark):
    letters, out = workspace(spark, "letters"), workspace(spark, "letters")
    lines = [f'{{"failed_at_unix_ms":{i},"error":"e","event":{{"event_id":"e{i}"}}}}' for i in range(9)]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(letters)
    seen = spark.sparkContext.accumulator(0)

    def publish(batch):
        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return batch.mapInPandas(count, batch.schema)

    ingest.replay_dead_letters(spark, letters, out, publish, 9).collect()
    assert seen.value == 9


def test_replay_moves_a_bounded_batch(spark):
    letters = workspace(spark, "letters")
    good = [f'{{"failed_at_unix_ms":{i},"error":"e","event":{{"event_id":"e{i}"}}}}' for i in range(6)]
    spark.createDataFrame([(v,) for v in good + [good[0], "{broken", "  "]], "value string").write.text(letters)
    out = workspace(spark, "letters")
    counts = ingest.replay_dead_letters(spark, letters, out, lambda b: b.where("event.event_id <> 'e1'"), 4).first()
    # The batch is the broken line, both copies of e0, and e1, which fails.
    assert (counts["processed"], counts["replayed"], counts["remaining"]) == (4, 2, 6)
    left = sorted(r["raw"] for r in read_dead_letters(spark, out).collect())
    assert left == sorted(good[1:] + ["{broken"])
