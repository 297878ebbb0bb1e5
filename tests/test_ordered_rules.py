"""The chunked rule against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import ordered_rules as rules


def loop(rows):
    state, out = {}, {}
    for key, row_id, at, quiet, repeat, mark in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last = state.get(key)
        fresh = last is None or (
            at - last[0] >= quiet and not (mark and mark == last[1] and at - last[0] < repeat)
        )
        state[key] = [at, mark, 1] if fresh else [last[0], last[1], last[2] + 1]
        out[row_id] = (fresh, state[key][0], state[key][2])
    return out


def made_rows(seed, hot=900, cold=40):
    rnd = random.Random(seed)
    rows, row_id = [], 0
    for key in range(6):
        at, quiet, repeat = rnd.randint(-50, 50), rnd.choice([0, 5, 20, 50]), rnd.choice([0, 10, 70, 120])
        for _ in range(hot if key == 0 else cold):  # key 0 owns most rows
            at += rnd.choice([0, 0, 1, 2] if key == 0 else [0, 1, 3, 9, 30, 400])
            rows.append((key, row_id, at, quiet, repeat, rnd.choice(["", "a", "b"])))
            row_id += 1
    return rows


@pytest.mark.parametrize("seed,periods,fan_in", [(1, None, 64), (2, 1, 64), (3, 1, 4), (4, 3, 4), (5, 2, 8)])
def test_chunks_do_not_change_the_result(spark, seed, periods, fan_in):
    rows = made_rows(seed)
    df = spark.createDataFrame(rows, "k int, id long, at long, quiet long, again long, mark string").repartition(5)
    got = rules.apply_quiet_rule(
        df, F.col("k"), F.col("at"), F.col("id"), F.col("quiet"), F.col("again"), F.col("mark"),
        periods=periods, fan_in=fan_in,
    )
    assert {r["id"]: (r["accepted"], r["anchor_at"], r["position"]) for r in got.collect()} == loop(rows)


def test_hot_key_is_cut_into_bounded_chunks(spark):
    rows = [(1, i, i, 10, 0, "") for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, id long, at long, quiet long, again long, mark string")
    got = rules.apply_quiet_rule(df, F.col("k"), F.col("at"), F.col("id"), F.col("quiet"), chunk_rows=100)
    assert "CoGroup" in got._jdf.queryExecution().toString()
    assert got.where("accepted").count() == 500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_zones_of_hot_periods_equal_the_loop(spark, seed):
    """Keys with more rows in a period than a chunk may hold, beside cold ones, with marks, ties and a null key."""
    rnd = random.Random(seed)
    rows, row_id = [], 0
    for key, n, quiet, repeat in (("h", 900, 300, 700), ("g", 700, 200, 0), ("m", 600, 0, 400), ("", 400, 150, 100), ("c", 30, 20, 50), ("d", 25, 5, 0)):
        at = rnd.randint(-50, 50)
        for _ in range(n):
            at += rnd.choice([0, 0, 0, 1, 2] if n > 100 else [1, 9, 30])
            # Long stretches of one mark: whole zones that cannot accept.
            rows.append((key, row_id, at, quiet, repeat, rnd.choice("ab") if rnd.random() < 0.02 else "a" if key != "m" else rnd.choice(["", "a"])))
            row_id += 1
    df = spark.createDataFrame(rows, "k string, id long, at long, quiet long, again long, mark string").repartition(5)
    got = rules.apply_quiet_rule(
        df, F.when(F.col("k") != "", F.col("k")), F.col("at"), F.col("id"), F.col("quiet"), F.col("again"), F.col("mark"), chunk_rows=60
    )
    assert {r["id"]: (r["accepted"], r["anchor_at"], r["position"]) for r in got.collect()} == loop(rows)


def test_one_key_in_one_period_uses_many_tasks(spark):
    rows = spark.range(400_000).selectExpr("id", "1 AS k", "(id * 7919) % 400000 AS at")
    got = rules.apply_quiet_rule(rows, F.col("k"), F.col("at"), F.col("id"), F.lit(10_000_000), chunk_rows=50_000)
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.count_if("accepted").alias("yes"), F.max("position").alias("p"))
    made = tasks.collect()
    assert len(made) > 1 and sum(r["n"] for r in made) == 400_000 and sum(r["yes"] for r in made) == 1 and max(r["p"] for r in made) == 400_000
    assert max(r["n"] for r in made) <= 250_000


def test_rate_limit_boundaries(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:59.999999", "2024-01-01 00:01:00"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(at)], "k string, id long, t string").withColumn(
        "at", F.col("t").cast("timestamp_ntz")
    )
    got = rules.rate_limit(df, "k", "at", "id", 2, 60_000_000).orderBy("id").collect()
    assert [(r["allowed"], r["remaining"]) for r in got] == [(True, 1), (True, 0), (False, 0), (True, 1)]


def test_nonce_lives_through_its_last_instant(spark):
    df = spark.createDataFrame([(0, "n", 0), (1, "n", 600), (2, "n", 601), (3, "m", 5)], "id long, nonce string, at long")
    got = rules.new_nonces(df.withColumn("us", F.col("at") * 1_000_000), "nonce", "us", "id", 600_000_000)
    # Entry 0 ends at 600 and still blocks then; 601 is past it.
    assert {r["id"]: r["fresh"] for r in got.collect()} == {0: True, 1: False, 2: True, 3: True}


def test_keys_with_few_rows_share_calls(spark):
    """Thousands of keys, one of them null, beside one with many rows; rows without a time are accepted each."""
    rnd = random.Random(5)
    rows = [(f"k{rnd.randrange(2000)}", i, rnd.randrange(400), 50, 120, rnd.choice(["", "a", "b"])) for i in range(5000)]
    rows += [("many", 5000 + i, i // 2, 20, 90, rnd.choice(["", "a"])) for i in range(400)] + [("", 6000 + i, i * 7, 20, 0, "a") for i in range(40)]
    df = spark.createDataFrame(rows + [("k1", 7000, None, 50, 120, "a"), ("k1", 7001, None, 50, 120, "a")], "k string, id long, at long, quiet long, again long, mark string")
    args = F.when(F.col("k") != "", F.col("k")), F.col("at"), F.col("id"), F.col("quiet"), F.col("again"), F.col("mark")
    small = rules.apply_quiet_rule(df, *args)
    assert "FlatMapGroupsInArrow [bucket" in small._jdf.queryExecution().executedPlan().toString()
    want = loop(rows) | {7000: (True, None, 1), 7001: (True, None, 1)}
    assert {r["id"]: (r["accepted"], r["anchor_at"], r["position"]) for r in small.collect()} == want
    # The key with many rows goes by chunks, the others by buckets.
    both = rules.apply_quiet_rule(df.where("at IS NOT NULL"), *args, chunk_rows=1200)
    assert {r["id"]: (r["accepted"], r["anchor_at"], r["position"]) for r in both.collect()} == loop(rows)
