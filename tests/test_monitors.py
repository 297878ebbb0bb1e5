from datetime import datetime

from pyspark.sql import functions as F

from slotwise.operators import monitors as mon
from slotwise.schemas import AUDIT

NOW = "2024-01-02T00:00:00Z"
FIELDS = (
    "monitor_id long, name string, program_id string, query_template string, comparator string, "
    "threshold double, schedule_minutes int, window_minutes int, cooldown_minutes int, dedupe_minutes int, "
    "retry_max_attempts int, retry_initial_backoff_ms int, webhook_url string, is_active boolean, dry_run boolean"
)
WINDOW = "FROM chain_events WHERE program_id = '{{program_id}}' AND timestamp >= '{{from}}' AND timestamp < '{{to}}'"
TEXT = f"SELECT count(*) {WINDOW}"


def monitor(i, **over):
    row = dict(
        monitor_id=i, name="Growth Monitor", program_id="P", query_template=TEXT, comparator="gt",
        threshold=1.0, schedule_minutes=1, window_minutes=60, cooldown_minutes=30, dedupe_minutes=60,
        retry_max_attempts=2, retry_initial_backoff_ms=5, webhook_url="https://x/y", is_active=True, dry_run=False,
    )
    row.update(over)
    return tuple(row.values())


def events(spark):
    times = ["2024-01-01 23:00:00", "2024-01-01 23:30:00", "2024-01-01 23:59:59.999999", "2024-01-02 00:00:00", "2024-01-01 22:59:59"]
    rows = [("P", t, "transaction", "s1") for t in times]
    return spark.createDataFrame(rows, "program_id string, t string, event_type string, signature string").select(
        "program_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "event_type", "signature"
    )


def audit(spark, rows=()):
    made = []
    for i, minutes, key in rows:
        at = datetime(2024, 1, 1, 23 - minutes // 60, (60 - minutes % 60) % 60) if minutes % 60 else datetime(2024, 1, 2 if minutes == 0 else 1, (24 - minutes // 60) % 24)
        made.append((i * 100 + minutes, i, 3.0, 1.0, "gt", True, True, "sent", "", "", at, at, at, False, key, 1, "", at))
    return spark.createDataFrame(made, AUDIT)


def states(spark, monitors, history=(), send=True):
    made = mon.evaluate(events(spark), spark.createDataFrame(monitors, FIELDS), audit(spark, history), NOW, send)
    return {r["monitor_id"]: (r["value"], r["delivery_state"]) for r in made.collect()}


def test_window_is_half_open(spark):
    got = states(spark, [
        monitor(1), monitor(2, window_minutes=61), monitor(3, query_template=f"select count(DISTINCT signature) as s {WINDOW}", threshold=0.0),
        monitor(4, program_id="none"), monitor(5, query_template="SELECT nothing FROM chain_events"),
    ])
    assert got[1] == (3.0, "queued") and got[2] == (4.0, "queued") and got[3] == (1.0, "queued")
    assert got[4] == (0.0, "not_triggered") and got[5] == (0.0, "evaluation_failed")


def test_every_state(spark):
    first = mon.evaluate(events(spark), spark.createDataFrame([monitor(5), monitor(6)], FIELDS), audit(spark), NOW)
    key = {r["monitor_id"]: r["dedupe_key"] for r in first.collect()}
    got = states(
        spark,
        [monitor(1, dry_run=True), monitor(2, threshold=9.0), monitor(4), monitor(5), monitor(6)],
        [(4, 5, "x"), (5, 40, key[5]), (6, 40, "another value")],
    )
    assert {i: s for i, (_, s) in got.items()} == {1: "dry_run", 2: "not_triggered", 4: "cooldown", 5: "deduped", 6: "queued"}
    assert states(spark, [monitor(1)], send=False)[1][1] == "disabled"


def test_rendered_query_and_outbox(spark):
    made = mon.evaluate(events(spark), spark.createDataFrame([monitor(1, program_id="P")], FIELDS), audit(spark), NOW)
    assert made.first()["query"] == (
        "SELECT count(*) FROM chain_events WHERE program_id = 'P' AND timestamp >= '2024-01-01T23:00:00Z'"
        " AND timestamp < '2024-01-02T00:00:00Z'"
    )
    box = mon.alert_outbox(made, 1704153600, "secret", "k").first()
    assert box["signature"].startswith("v1=") and len(box["signature"]) == 67 and box["max_attempts"] == 2


def test_validation_defaults_and_reasons(spark):
    rows = [
        monitor(1, comparator=" ", cooldown_minutes=0, window_minutes=-1), monitor(2, name=" "),
        monitor(3, comparator="between"), monitor(4, program_id="0"), monitor(5, webhook_url="ftp://x"),
        monitor(6, dedupe_minutes=20161), monitor(7, query_template="DELETE FROM t"),
    ]
    got = {r["monitor_id"]: r for r in mon.validate_monitors(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[1]["reject_reason"] is None
    assert (got[1]["comparator"], got[1]["cooldown_minutes"], got[1]["window_minutes"]) == ("lt", 30, 60)
    assert [got[i]["reject_reason"] for i in range(2, 8)] == [
        "name is required", "comparator must be one of: gt, gte, lt, lte", "program_id must be base58",
        "webhook_url is invalid", "dedupe_minutes cannot exceed 20160",
        "query_template is invalid: only read-only SELECT queries are allowed",
    ]


def test_texts_of_many_forms(spark):
    """The shared counts and the texts' own plans give the same values; failures stay with their monitors."""
    texts = [
        TEXT,
        "SELECT count(*) FROM chain_events WHERE program_id='{{program_id}}' AND timestamp >= '{{from}}' AND timestamp < '{{to}}'",
        f"SELECT 'x' AS a, NULL AS b, count_if(event_type = 'transaction') AS n {WINDOW}",
        f"WITH q AS (SELECT signature, count(*) AS n {WINDOW} GROUP BY 1) SELECT signature, n FROM q ORDER BY n DESC, signature",
        "SELECT count(*) FROM chain_events WHERE concat('<', program_id, '>') = '<{{program_id}}>' AND NOT timestamp < '{{from}}'",
        "SELECT '{{program_id}}' AS p, '7.5' AS text_number",
        f"SELECT max(signature) {WINDOW} LIMIT 1",
        "SELECT missing FROM chain_events",
        "SELECT count(*) FROM other",
        "SELECT 1 / (count(*) - count(*)) FROM chain_events",
        "SELECT count(*) FROM chain_events WHERE program_id = {{program_id}}",
        "SELECT java_method('java.lang.Math', 'abs', -1)",
        "SELECT 1; SELECT 2",
    ]
    rows = [monitor(10 * i + j, query_template=t, program_id=p, window_minutes=w) for i, t in enumerate(texts) for j, (p, w) in enumerate([("P", 60), ("P", 61), ("it's", 60)])]
    made = mon.evaluate(events(spark), spark.createDataFrame(rows, FIELDS), audit(spark), NOW)
    got = {r["monitor_id"]: (r["value"], r["delivery_state"] == "evaluation_failed", r["error"]) for r in made.collect()}
    assert [got[j][:2] for j in range(3)] == [got[10 + j][:2] for j in range(3)] == [(3.0, False), (4.0, False), (0.0, False)]
    assert [got[20 + j][0] for j in range(3)] == [3.0, 4.0, 0.0]
    assert got[30][0] == 3.0 and got[31][0] == 4.0 and got[32][2] == "failed to read metric value: no numeric value"
    assert [got[40 + j][0] for j in range(3)] == [4.0, 5.0, 0.0]
    assert [got[50 + j][0] for j in range(3)] == [7.5] * 3
    assert got[60][2].startswith("failed to read")
    for i, said in ((70, "query execution failed: [UNRESOLVED"), (80, "query execution failed: table is not allowed: other"),
                    (90, "query execution failed: [DIVIDE_BY_ZERO]"), (100, "query execution failed: a place holder"),
                    (110, "query execution failed: function is not allowed: java_method"), (120, "query validation failed: multiple")):
        assert all(got[i + j][1] and got[i + j][2].startswith(said) for j in range(3)), got[i]


def test_window_starts_reach_the_scan_and_programs_the_join(spark):
    from slotwise.operators import templates
    from slotwise.plans.inputs import VARIED_TEXTS, shape

    log = shape(spark, "/root/testdata/sf0.001", "chain_events")
    params = spark.createDataFrame([("Prog1", 60, "2024-01-28T00:00:00Z"), ("Prog2", 60, "2024-01-20T00:00:00Z")], "_program_id string, _window int, _from string")
    made = templates.text_values(spark, VARIED_TEXTS[1].replace("''", "'"), params, {"chain_events": log}, "2024-01-20T00:00:00Z", "2024-01-29T06:00:00Z")
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in text and "LessThan(ts,2024-01-29T06:00)" in text
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_two_ticks_deliver_once(spark):
    log, made = audit(spark), []
    monitors = spark.createDataFrame([monitor(1, cooldown_minutes=0), monitor(2)], FIELDS)
    later = "2024-01-02T00:01:00Z"
    first = mon.audit_rows(mon.evaluate(events(spark), monitors, log, NOW))
    assert {r["delivery_state"] for r in first.collect()} == {"queued"}
    for tick_log in (
        first,  # no report yet
        mon.settle(first, first.selectExpr("evaluation_id", "true AS delivered", "1 AS retry_attempts", "'' AS error")),
        mon.settle(first, first.selectExpr("evaluation_id", "false AS delivered", "2 AS retry_attempts", "'timeout' AS error")),
    ):
        made.append({r["monitor_id"]: r["delivery_state"] for r in mon.evaluate(events(spark), monitors, tick_log, later).collect()})
    assert "queued" not in made[0].values() and made[0] == made[1]
    assert set(made[2].values()) == {"queued"}


def test_outcomes_of_deliveries(spark):
    monitors = spark.createDataFrame([monitor(i) for i in (1, 2, 3)], FIELDS)
    log = mon.audit_rows(mon.evaluate(events(spark), monitors, audit(spark), NOW))
    ids = {r["monitor_id"]: r["evaluation_id"] for r in log.collect()}
    reports = [(ids[1], False, 1, "refused"), (ids[1], True, 2, ""), (ids[2], False, 3, "timeout")]
    made = mon.settle(log, spark.createDataFrame(reports, "evaluation_id long, delivered boolean, retry_attempts int, error string"))
    got = {r["monitor_id"]: (r["delivery_state"], r["alert_sent"], r["retry_attempts"], r["error"]) for r in made.collect()}
    assert got == {1: ("sent", True, 2, ""), 2: ("failed", False, 3, "timeout"), 3: ("queued", False, 0, "")}
    assert made.columns == log.columns


def test_several_changes_of_one_monitor_are_refused(spark):
    base = spark.createDataFrame([monitor(1), monitor(2)], FIELDS)
    changes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "monitor_id long, name string")
    got = {r["monitor_id"]: (r["name"], r["reject_reason"]) for r in mon.patch_monitors(base, changes).collect()}
    assert got == {1: ("Growth Monitor", "several changes of one monitor"), 2: ("c", None)}


def test_purge_drops_days_and_cuts_the_edge(spark):
    from pyspark.sql import functions as F

    from slotwise.plans.inputs import shape
    from slotwise.session import workspace
    from slotwise.sources import event_log

    now, path = "2024-01-20T06:00:00Z", workspace(spark, "audit")
    audit = shape(spark, "/root/testdata/sf0.001", "audit")
    event_log.append_audit(audit, path)
    want = mon.kept_audit(event_log.read_audit(spark, path), now, 48)
    keys = sorted(r[0] for r in want.select("evaluation_id").collect())
    for _ in range(2):  # a second purge finds nothing more
        event_log.purge_audit(spark, path, now, 48)
        left = event_log.read_audit(spark, path)
        assert sorted(r[0] for r in left.select("evaluation_id").collect()) == keys
    assert left.where(F.to_date("created_at") < F.lit("2024-01-18").cast("date")).count() == 0


def test_purge_may_die_after_any_step(spark):
    """Stopped after its first, second, ... step, and inside the writes; the next purge ends it without losing a kept row."""
    from slotwise.plans.inputs import shape
    from slotwise.session import workspace
    from slotwise.sources import event_log

    now, audit = "2024-01-20T06:00:00Z", shape(spark, "/root/testdata/sf0.001", "audit").where("created_at >= timestamp_ntz'2024-01-16'")

    class Died(Exception):
        pass

    def ids(df):
        return sorted(r[0] for r in df.select("evaluation_id").collect())

    want, seen = ids(mon.kept_audit(audit, now, 48)), set()
    for stop in range(12):
        path, steps = workspace(spark, "audit"), []
        event_log.append_audit(audit.coalesce(1), path)

        def die(step):
            steps.append(step)
            if len(steps) == stop + 1:
                if step == "marker set":  # and in the middle of the day's replacement
                    import glob
                    import os

                    for f in glob.glob(f"{path}/day=2024-01-18/*.parquet"):
                        os.truncate(f, 0)
                raise Died

        try:
            event_log.purge_audit(spark, path, now, 48, die)
            break
        except Died:
            seen.add(steps[-1])
        later = "2024-01-20T07:00:00Z" if stop % 2 else now
        event_log.purge_audit(spark, path, later, 48)
        assert ids(event_log.read_audit(spark, path)) == (want if later == now else ids(mon.kept_audit(audit, later, 48)))
        assert not spark._jvm.java.io.File(f"{path}-purged-2024-01-18").exists()
    assert seen == {"copy written", "marker set", "day replaced", "marker gone", "copy gone", "day dropped"} and stop >= 7
