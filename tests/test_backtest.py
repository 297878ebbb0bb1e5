import pytest
from pyspark.sql import functions as F

from slotwise.operators import backtest as bt
from slotwise.operators import history
from slotwise.plans.inputs import shape

SF = "/root/testdata/sf0.001"


def test_canned_window(spark):
    row = [(0, 100, 50, 40, 500, 200, 160)]
    metrics = spark.createDataFrame(row, "launch_idx int, " + ", ".join(f"{c} long" for c in bt.COUNTS))
    got = bt.judged(metrics, bt.Settings.of()).first()
    assert (got["event_growth_ratio"], got["unique_signer_growth_ratio"], got["transaction_growth_ratio"]) == (5, 4, 4)
    assert got["score"] == 3.5 and got["outcome"] == "worked"
    assert [s["signal"] for s in got["signals"]] == ["event_growth", "unique_signer_growth", "transaction_growth"]


def test_settings():
    assert bt.Settings.of(baseline_hours=0, event_ratio=-1.0) == bt.Settings()
    with pytest.raises(ValueError):
        bt.Settings.of(evaluation_hours=337)


def events(spark, times):
    rows = [("P", t, "transaction", s) for t, s in times]
    return spark.createDataFrame(rows, "program_id string, t string, event_type string, signature string").select(
        "program_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "event_type", "signature"
    )


def launches(spark, rows):
    df = spark.createDataFrame(rows, "launch_idx long, name string, program_id string, launch_at string")
    return history.valid_launches(df).where("reject_reason IS NULL").drop("reject_reason")


def test_boundaries_duplicates_and_empty(spark):
    log = events(spark, [
        ("2024-01-01 12:00:00", "a"),   # first instant of the baseline
        ("2024-01-02 11:59:59", None),  # no signature counts as one signer
        ("2024-01-02 12:00:00", "a"),   # the launch itself belongs to the evaluation
        ("2024-01-02 18:00:00", "b"),   # end of the evaluation is outside
    ])
    asked = launches(spark, [
        (0, "", "P", "2024-01-02T12:00:00.900Z"), (1, "same", "P", "2024-01-02T12:00:00Z"),
        (2, "none", "Q", "2024-01-02T12:00:00Z"), (3, "bad", "P", "2024-01-02"),
    ])
    for limit in (None, 0):  # broadcast and bucketed paths
        got = {r["launch_idx"]: r for r in bt.backtest(log, asked, bt.Settings.of(), limit).collect()}
        assert set(got) == {0, 1, 2}
        for i in (0, 1):
            assert [got[i][c] for c in bt.COUNTS] == [2, 2, 2, 1, 1, 1]
        assert got[0]["name"] == "P"
        assert [got[2][c] for c in bt.COUNTS] == [0] * 6 and got[2]["event_growth_ratio"] == 1.0


def test_bucketed_join_equals_broadcast(spark):
    log = shape(spark, SF, "chain_events")
    asked = history.valid_launches(shape(spark, SF, "launch_requests")).where("reject_reason IS NULL")
    windows = bt.launch_windows(asked, bt.Settings.of())
    a = bt.window_metrics(log, windows)
    for b in (bt.swept_metrics(log, windows, limit=0), bt.paired_metrics(log, windows, limit=0)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scoring_needs_history(spark):
    log = events(spark, [("2024-01-01 12:00:00", "a")])
    few = bt.backtest(log, launches(spark, [(0, "", "P", "2024-01-02T12:00:00Z")]), bt.Settings.of())
    with pytest.raises(ValueError):
        bt.score_launches(few, few, bt.Settings.of())


def test_counts_equal_pairs(spark):
    """Against every event joined with every launch: repeated times, signers with gaps over many stretches, odd lengths."""
    import random

    r = random.Random(4)
    rows = [(r.choice("PQ"), r.randrange(400) * 1800, r.choice(["transaction", "account"]), r.choice([None, "", "a", "b", *map(str, range(30))])) for _ in range(3000)]
    log = spark.createDataFrame(rows, "program_id string, s long, event_type string, signature string").selectExpr(
        "program_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS timestamp", "event_type", "signature"
    )
    asked = [(i, r.choice("PQR"), r.randrange(300) * 900, r.choice([1800, 36000, 90000]), r.choice([900, 40000])) for i in range(60)]
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)"
    windows = spark.createDataFrame(asked, "launch_idx long, program_id string, s long, b long, e long").selectExpr(
        "launch_idx", "program_id", f"{at} AS launch_ts", f"{at} - make_dt_interval(0, 0, 0, b) AS baseline_start", f"{at} + make_dt_interval(0, 0, 0, e) AS evaluation_end"
    )
    got = bt.swept_metrics(log, windows)
    log.createOrReplaceTempView("_log")
    windows.createOrReplaceTempView("_windows")
    counts = ", ".join(
        f"count_if({inside}) {name}_events, count(DISTINCT CASE WHEN {inside} THEN coalesce(signature, '') END) {name}_unique_signatures, "
        f"count_if({inside} AND event_type = 'transaction') {name}_transactions"
        for name, inside in (("baseline", "timestamp >= baseline_start AND timestamp < launch_ts"), ("evaluation", "timestamp >= launch_ts AND timestamp < evaluation_end"))
    )
    want = spark.sql(f"SELECT launch_idx, {counts} FROM _windows w LEFT JOIN _log l ON l.program_id = w.program_id GROUP BY launch_idx")
    assert sorted(map(tuple, got.select("launch_idx", *bt.COUNTS).collect())) == sorted(map(tuple, want.select("launch_idx", *bt.COUNTS).collect()))


def test_no_join_pairs_events_with_launches(spark):
    """Every join's rows are bounded by events plus launches, read from the executed plan."""
    log = shape(spark, SF, "chain_events")
    asked = history.valid_launches(shape(spark, SF, "launch_requests")).where("reject_reason IS NULL")
    made = bt.swept_metrics(log, bt.launch_windows(asked, bt.Settings.of()), limit=0)
    made.collect()
    bound = log.count() + 3 * asked.count()
    plans, sizes = [made._jdf.queryExecution().executedPlan()], []
    while plans:
        node = plans.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            sizes.append(node.metrics().apply("numOutputRows").value())
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(node.executedPlan())
        elif "QueryStage" in name:
            plans.append(node.plan())
        children = node.children()
        plans += [children.apply(i) for i in range(children.size())]
    assert len(sizes) >= 5 and max(sizes) <= 3 * log.count() + 3 * asked.count(), sizes
    assert sorted(sizes)[-1] <= 3 * bound
