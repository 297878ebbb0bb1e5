import random

from pyspark.sql import functions as F

from slotwise.operators import service_levels as sl


def test_increase_across_buckets_and_resets(spark):
    rnd = random.Random(3)
    rows, at, value = [], 0, 0
    for i in range(400):
        at += rnd.choice([1, 5, 40, 200])
        value = 0 if rnd.random() < 0.05 else value + rnd.randint(0, 9)
        rows.append((i, "a" if i % 5 else "b", at, float(value)))
    df = spark.createDataFrame(rows, "sample_id long, s string, at long, c double").withColumn("ts", F.timestamp_seconds("at"))
    got = sl.counter_increase(df, ["s"], "c", 300, 300 * sl.SECOND)
    got = {r["sample_id"]: r["increase"] for r in got.collect()}
    want, last, deltas = {}, {}, []
    for i, s, t, v in rows:
        prev = last.get(s)
        deltas.append((s, t, 0.0 if prev is None else (v if v < prev else v - prev)))
        last[s] = v
    for i, s, t, _ in rows:
        want[i] = sum(d for s2, t2, d in deltas if s2 == s and t - 300 < t2 <= t)
    assert got == want


def test_alert_needs_the_whole_hold(spark):
    flags = [True] * 5 + [False] + [True] * 3
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "step long, breached boolean")
    got = [r["state"] for r in sl.alert_states(df, 60).orderBy("step").collect()]
    assert got == ["pending", "pending", "firing", "firing", "firing", "inactive", "pending", "pending", "firing"]


def test_lag_floor_and_empty(spark):
    df = spark.createDataFrame([(1000,)], "observed_at_unix_ms long")
    assert sl.ingestion_lag(df, 500).first()[0] == 0
    assert sl.ingestion_lag(df.where("false"), 500).first()[0] == 0
    assert sl.ingestion_lag(df, 2500).first()[0] == 1500


def test_lag_breaches_beyond_the_limit_only(spark):
    at = [0, 30_000, 31_000, 400_001, 700_000]
    df = spark.createDataFrame([(a,) for a in at], "observed_at_unix_ms long")
    got = {r["step"]: r["breached"] for r in sl.lag_checks(df).collect()}
    want = {s: s * 30_000 - max(a for a in at if a <= s * 30_000) > 120_000 for s in range(0, 25)}
    assert got == {s: want[s] for s in got} and min(got) == 0 and max(got) == 24


def test_increase_at_irregular_samples(spark):
    """Against every pair of samples: equal times, resets, gaps longer than the window, samples on a window's edge."""
    import random

    from slotwise.operators import service_levels as sl

    r = random.Random(8)
    rows = sorted((i % 3, r.choice([r.randrange(90) * 600, r.randrange(54_000), 3600 * r.randrange(15)]), float(r.randrange(500))) for i in range(400))
    rows = [(n, f"s{s}", t, v) for n, (s, t, v) in enumerate(rows)]
    samples = spark.createDataFrame(rows, "sample_id long, series string, s long, c double").selectExpr(
        "sample_id", "series", "c", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts"
    )
    want, last = {}, {}
    grown = []
    for n, s, t, v in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        p = last.get(s)
        grown.append((n, s, t, 0.0 if p is None else v if v < p else v - p))
        last[s] = v
    for n, s, t, _ in grown:
        want[n] = sum(d for _, s2, t2, d in grown if s2 == s and t - 3600 < t2 <= t)
    for bucket in (3600, 7200, 86400):
        made = sl.counter_increase(samples, ["series"], "c", 3600, bucket * sl.SECOND)
        assert {x["sample_id"]: x["increase"] for x in made.collect()} == want
    assert "ts" in made.columns and "RangeFrame, -" not in made._jdf.queryExecution().executedPlan().toString()


def test_rollup_answers_many_windows(spark):
    """Counts of whole hours are exact, distinct signers within the sketch's error; one rollup for all windows."""
    from slotwise.operators import rollups

    log = spark.range(60_000).selectExpr(
        "concat('P', id % 2) program_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 86400) AS timestamp",
        "CASE WHEN id % 3 = 0 THEN 'transaction' ELSE 'account' END event_type", "CASE WHEN id % 11 > 0 THEN cast(id % 9000 AS string) END signature",
    )
    hour = "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast({} AS int))"
    windows = spark.range(40).selectExpr("id", "concat('P', id % 3) program_id", f"{hour.format('id % 20')} window_start", f"{hour.format('id % 20 + id % 7')} window_end")
    got = {r["id"]: r for r in rollups.windows_from_rollup(rollups.hourly_rollup(log), windows).collect()}
    rows = [(r.program_id, r.timestamp, r.event_type, r.signature or "") for r in log.collect()]
    assert len(got) == 40
    for w in windows.collect():
        held = [r for r in rows if r[0] == w.program_id and w.window_start <= r[1] < w.window_end]
        r = got[w["id"]]
        assert (r["events"], r["transactions"]) == (len(held), sum(x[2] == "transaction" for x in held))
        exact = len({x[3] for x in held})
        assert abs(r["signers"] - exact) <= 0.05 * exact
