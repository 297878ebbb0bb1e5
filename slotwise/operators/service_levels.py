"""Counter increases, error-rate objectives, lag and service totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import blank_default, sanitize_stage
from ..functions.timing import micros

SECOND = 1_000_000
GRID = 30 * SECOND

# Fixed values: (window s, hold s, alert above) of the ratio objectives and the lag objective.
QUERY_OBJECTIVE = (300, 600, 0.05)
MONITOR_OBJECTIVE = (600, 900, 0.10)
LAG_LIMIT_MS, LAG_HOLD = 120_000, 600
# Fixed values: (warning, critical) levels shown on the boards.
LAG_LEVELS, QUERY_LEVELS, MONITOR_LEVELS = (60_000, 120_000), (0.03, 0.05), (0.05, 0.10)


def _with_lent_rows(df: DataFrame, at: str, span: int, bucket: int) -> DataFrame:
    if bucket < span:
        raise ValueError("a bucket must hold the whole span")
    own = F.floor(F.col(at) / bucket)
    lent = F.col(at) >= (own + 1) * bucket - span + 1
    both = F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_bucket", F.explode(both))


def trailing_grid_sums(df: DataFrame, at: str, span: int, bucket: int, **columns: str) -> DataFrame:
    """Sums over the last ``span`` steps of a full grid, as differences of running sums.

    A sliding frame would add up the whole span again for every step.
    """
    by_step = W.partitionBy("_bucket").orderBy(at)
    running = by_step.rowsBetween(W.unboundedPreceding, W.currentRow)
    made = _with_lent_rows(df, at, span, bucket)
    made = made.withColumns({f"_run_{n}": F.sum(c).over(running) for n, c in columns.items()})
    made = made.withColumns(
        {n: F.col(f"_run_{n}") - F.coalesce(F.lag(f"_run_{n}", span).over(by_step), F.lit(0)) for n in columns}
    )
    return made.where("_bucket = _own").drop("_bucket", "_own", *[f"_run_{n}" for n in columns])


def trailing_sum(df: DataFrame, keys: list[str], at: str, span: int, bucket: int, name: str, column: str) -> DataFrame:
    """``name``: the column's sum over the last ``span`` units up to and including each row's time.

    The sum up to a time less the sum up to ``span`` before it: each row also stands as a probe at the earlier
    time, one running sum passes over rows and probes in order, and rows of one time share their probe's
    sum. So work does not grow with the rows in a span. A busy key is cut into time buckets; the rows
    of the last ``span`` units of a bucket are lent to the next one, where they only feed the sum.
    """
    spread = _with_lent_rows(df, at, span, bucket)
    held = F.struct(*df.columns).alias("_row")
    point = F.struct(F.col(at).alias("x"), F.lit(0).alias("probe"), F.col(column).alias("v"))
    probe = F.struct((F.col(at) - span).alias("x"), F.lit(1).alias("probe"), F.lit(0).cast(df.schema[column].dataType).alias("v"))
    both = F.explode(F.when(F.col("_bucket") == F.col("_own"), F.array(point, probe)).otherwise(F.array(point)))
    spread = spread.select(*keys, "_bucket", "_own", F.col(at).alias("_at"), held, both.alias("_p"))
    # Of equal times rows come before probes, and rows of one time see one another.
    upto = W.partitionBy(*keys, "_bucket").orderBy("_p.x", "_p.probe")
    summed = spread.withColumn("_sum", F.sum("_p.v").over(upto))
    early = F.max(F.when(F.col("_p.probe") == 1, F.col("_sum"))).over(W.partitionBy(*keys, "_bucket", "_at"))
    made = summed.withColumn("_early", early).where("_p.probe = 0 AND _bucket = _own")
    return made.select("_row.*", (F.col("_sum") - F.coalesce("_early", F.lit(0))).alias(name))


def counter_deltas(samples: DataFrame, series: list[str], counters: list[str], bucket_us: int) -> DataFrame:
    """Reset-aware growth since the previous sample of the series; the first adds 0.

    Works per (series, time bucket); the last sample of the bucket before is
    looked up in a table of one row per bucket.
    """
    place = F.struct("at_us", "sample_id")
    rows = samples.withColumn("at_us", micros(F.col("ts"))).withColumn(
        "_bucket", F.floor(F.col("at_us") / bucket_us)
    )
    last = rows.groupBy(*series, "_bucket").agg(*[F.max_by(c, place).alias(f"_last_{c}") for c in counters])
    before = W.partitionBy(*series).orderBy("_bucket")
    carried = last.select(
        *series, "_bucket", *[F.lag(f"_last_{c}").over(before).alias(f"_carry_{c}") for c in counters]
    )
    inside = W.partitionBy(*series, "_bucket").orderBy("at_us", "sample_id")
    out = rows.join(carried, [*series, "_bucket"])
    for c in counters:
        previous = F.coalesce(F.lag(c).over(inside), F.col(f"_carry_{c}"))
        out = out.withColumn(f"_prev_{c}", previous)
    for c in counters:
        prev = F.col(f"_prev_{c}")
        growth = (
            F.when(prev.isNull(), F.lit(0.0)).when(F.col(c) < prev, F.col(c)).otherwise(F.col(c) - prev)
        )
        out = out.withColumn(f"{c}_delta", growth)
    return out.drop("_bucket", *[f"_carry_{c}" for c in counters], *[f"_prev_{c}" for c in counters])


def counter_increase(
    samples: DataFrame, series: list[str], counter: str, window_s: int, bucket_us: int = 3600 * SECOND
) -> DataFrame:
    """Growth of a counter over (t - window, t] at every sample."""
    deltas = counter_deltas(samples, series, [counter], bucket_us)
    span = window_s * SECOND
    return trailing_sum(deltas, series, "at_us", span, max(bucket_us, span), "increase", f"{counter}_delta")


def grid_increases(
    samples: DataFrame, series: list[str], counters: list[str], window_s: int, bucket_us: int = 3600 * SECOND
) -> DataFrame:
    """Growth over the window summed over all series, on a full 30 s grid.

    Windows are whole grid steps, so growth is first summed per step; what is
    left depends on the time covered, not on the number of samples.
    """
    deltas = counter_deltas(samples, series, counters, bucket_us)
    step = F.ceil(F.col("at_us") / GRID)
    cells = deltas.groupBy(step.alias("step")).agg(*[F.sum(f"{c}_delta").alias(c) for c in counters])
    full = full_grid(cells, counters)
    span = window_s * SECOND // GRID
    bucket = max(span, 86400 * SECOND // GRID)
    return trailing_grid_sums(full, "step", span, bucket, **{f"{c}_increase": c for c in counters})


def full_grid(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Every step from the first to the last of ``cells``, zeros where nothing happened."""
    hours = 3600 * SECOND // GRID
    ends = cells.agg(F.min("step").alias("low"), F.max("step").alias("high"))
    blocks = ends.select(
        "low", "high", F.explode(F.sequence(F.floor(F.col("low") / hours), F.floor(F.col("high") / hours))).alias("h")
    ).repartition("h")
    grid = blocks.select(
        "low", "high", F.explode(F.sequence(F.col("h") * hours, F.col("h") * hours + hours - 1)).alias("step")
    ).where("step BETWEEN low AND high").select("step")
    return grid.join(cells, "step", "left").fillna(0, subset=columns)


def lag_checks(log: DataFrame, limit_ms: int = LAG_LIMIT_MS) -> DataFrame:
    """Per grid step whether the newest event seen by then is older than the limit.

    That is so when the steps within the limit saw no event. An event exactly on a step counts in
    the next one too, as its age then still equals the limit.
    """
    grid_ms = GRID // 1000
    if limit_ms % grid_ms:
        raise ValueError(f"the limit must be a multiple of {grid_ms} ms")
    at = F.col("observed_at_unix_ms")
    step = F.ceil(at / grid_ms)
    steps = F.when(at % grid_ms == 0, F.array(step, step + 1)).otherwise(F.array(step))
    cells = log.select(F.explode(steps).alias("step")).groupBy("step").agg(F.count("*").alias("events"))
    span = limit_ms // grid_ms
    made = trailing_grid_sums(full_grid(cells, ["events"]), "step", span, max(span, 86400 * SECOND // GRID), _seen="events")
    return made.select("step", (F.col("_seen") == 0).alias("breached"))


def error_rate(
    samples: DataFrame, series: list[str], errors: str, total: str, objective: tuple = QUERY_OBJECTIVE
) -> DataFrame:
    """Ratio of error growth to growth of the total (at least 1) per grid step."""
    window_s, _, above = objective
    grown = grid_increases(samples, series, [errors, total], window_s)
    ratio = F.col(f"{errors}_increase") / F.greatest(F.col(f"{total}_increase"), F.lit(1.0))
    return grown.withColumn("ratio", ratio).withColumn("breached", ratio > above)


def alert_states(checks: DataFrame, hold_s: int, at: str = "step", breached: str = "breached") -> DataFrame:
    """inactive, pending, or firing once the condition held for ``hold_s``.

    On a full grid the condition held since ``hold_s`` ago exactly when every
    step from then to now is breached.
    """
    steps = hold_s * SECOND // GRID + 1
    flags = checks.withColumn("_flag", F.col(breached).cast("int"))
    day = 86400 * SECOND // GRID
    held = trailing_grid_sums(flags, at, steps, max(day, steps), _held="_flag")
    state = F.when(~F.col(breached), "inactive").when(F.col("_held") == steps, "firing").otherwise("pending")
    return held.withColumn("state", state).drop("_flag", "_held")


def level(value: Column, levels: tuple) -> Column:
    warning, critical = levels
    return F.when(value >= critical, "red").when(value >= warning, "orange").otherwise("green")


def request_stats(requests: DataFrame) -> DataFrame:
    named = requests.select(
        blank_default(F.col("method"), "UNKNOWN").alias("method"),
        blank_default(F.col("path"), "/unknown").alias("path"),
        "status",
        "duration_micros",
    )
    return (
        named.groupBy("method", "path", "status")
        .agg(F.count("*").alias("requests"), F.sum("duration_micros").alias("duration_sum_micros"))
        .orderBy("path", "method", "status")
    )


def stage_errors(failures: DataFrame, column: str = "stage") -> DataFrame:
    return (
        failures.groupBy(sanitize_stage(F.col(column)).alias("stage")).agg(F.count("*").alias("errors")).orderBy("stage")
    )


def ingest_counters(log: DataFrame) -> DataFrame:
    published = F.col("publish_state") == "published"
    at = F.col("observed_at_unix_ms")
    return log.agg(
        F.count("*").alias("events_total"),
        F.count_if(published).alias("published_total"),
        F.count_if(~published).alias("publish_failures_total"),
        F.count_if(F.col("delivery_state") == "failed").alias("delivery_failures_total"),
        F.coalesce(F.max(at), F.lit(0)).alias("last_event_observed_ms"),
        F.coalesce(F.max(F.when(published, at)), F.lit(0)).alias("last_publish_success_ms"),
        F.coalesce(F.max(F.when(~published, at)), F.lit(0)).alias("last_publish_failure_ms"),
    )


def ingestion_lag(log: DataFrame, now_ms: int) -> DataFrame:
    newest = F.max("observed_at_unix_ms")
    lag = F.when(F.coalesce(newest, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(now_ms) - newest, F.lit(0))
    )
    return log.agg(lag.cast("bigint").alias("ingestion_lag_ms"))


def latest_metrics(samples: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return samples.groupBy(metric).agg(F.max_by(value, F.struct("ts", "sample_id")).alias("value"))
