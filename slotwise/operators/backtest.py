"""Launch backtests and launch scoring, all launches in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import SIGNALS, clamp, contribution, growth_ratio, probability_band
from ..functions.timing import micros, rfc3339
from ..session import dimension

# Default settings and window limit.
MAX_WINDOW_HOURS = 336
COUNTS = (
    "baseline_events",
    "baseline_unique_signatures",
    "baseline_transactions",
    "evaluation_events",
    "evaluation_unique_signatures",
    "evaluation_transactions",
)


@dataclass(frozen=True)
class Settings:
    baseline_hours: int = 24
    evaluation_hours: int = 6
    min_events: int = 100
    event_ratio: float = 2.0
    signer_ratio: float = 1.7
    transaction_ratio: float = 2.0

    @staticmethod
    def of(**given) -> "Settings":
        """Non-positive values take the default; windows have a limit."""
        made = Settings(**{k: v for k, v in given.items() if v is not None and v > 0})
        for name in ("baseline_hours", "evaluation_hours"):
            if getattr(made, name) > MAX_WINDOW_HOURS:
                raise ValueError(f"{name} cannot exceed {MAX_WINDOW_HOURS}")
        return made


def launch_windows(launches: DataFrame, settings: Settings) -> DataFrame:
    """Whole-second windows around each launch: [start, launch) and [launch, end)."""
    at = F.date_trunc("second", F.col("launch_ts")).cast("timestamp_ntz")
    return (
        launches.withColumn("launch_ts", at)
        .withColumn("baseline_start", at - F.expr(f"INTERVAL {settings.baseline_hours} HOUR"))
        .withColumn("evaluation_end", at + F.expr(f"INTERVAL {settings.evaluation_hours} HOUR"))
    )


#: Signers' rows are chained within stretches of time and from stretch to stretch, so that a busy signer is not one task's.
CHAIN_US = 6 * 3_600_000_000
#: Time buckets over the whole span, in which running sums are kept at two levels.
BUCKETS = 1024
_AT = ["program_id", "x"]


def _bounded(events: DataFrame, windows: DataFrame) -> tuple[DataFrame, int]:
    """Events of the launches' programs between the outermost window bounds, which are literals to the scan, and the span."""
    bounds = windows.agg(F.min("baseline_start").alias("low"), F.max("evaluation_end").alias("high")).first()
    if bounds["low"] is None:
        return events.where(F.lit(False)), 1
    low, high = (F.lit(str(bounds[c])).cast("timestamp_ntz") for c in ("low", "high"))
    span = int((bounds["high"] - bounds["low"]).total_seconds() * 1_000_000)
    return events.where((F.col("timestamp") >= low) & (F.col("timestamp") < high)), max(span, 1)


def _chained(facts: DataFrame) -> DataFrame:
    """Events (program_id, signature, t, ...) with ``before``, the time of the signer's previous one in the program."""
    own = ["program_id", "signature", "chunk"]
    facts = facts.withColumn("chunk", F.floor(F.col("t") / CHAIN_US))
    inside = F.lag("t").over(W.partitionBy(*own).orderBy("t"))
    # A row for each stretch of a signer: the last time in it reaches the first event of the next one.
    ends = facts.groupBy(*own).agg(F.max("t").alias("last"))
    ends = ends.withColumn("left", F.lag("last").over(W.partitionBy("program_id", "signature").orderBy("chunk"))).drop("last")
    joined = facts.withColumn("inside", inside).join(ends, own)
    return joined.withColumn("before", F.coalesce("inside", "left")).drop("inside", "left", "chunk")


def _counts_before(points: DataFrame, probes: DataFrame, sums: list[str], width: int, limit: int | None) -> DataFrame:
    """For every probe (program_id, x) the sums over the program's points with a smaller x.

    Whole buckets are added up per program; only buckets with a probe are looked at point by point, as one
    sorted run of points and probes. Nothing is paired.
    """
    bucket = F.floor(F.col("x") / width).alias("bucket")
    points, probes = points.select("*", bucket), probes.select(*_AT, bucket)
    asked = probes.select("program_id", "bucket").distinct()
    zeros = [F.lit(0).cast("bigint").alias(c) for c in sums]
    cells = points.groupBy("program_id", "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    cells = cells.unionByName(asked.select("program_id", "bucket", *zeros)).groupBy("program_id", "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    # At most a row a bucket and program.
    earlier = W.partitionBy("program_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = cells.select("program_id", "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    near = points.join(dimension(asked, limit), ["program_id", "bucket"], "left_semi").withColumn("probe", F.lit(0))
    both = near.unionByName(probes.select("*", *zeros, F.lit(1).alias("probe")))
    upto = W.partitionBy("program_id", "bucket").orderBy("x", F.desc("probe")).rowsBetween(W.unboundedPreceding, 0)
    fine = both.select(*_AT, "bucket", "probe", *[F.sum(c).over(upto).alias(c) for c in sums]).where("probe = 1")
    return fine.join(base, ["program_id", "bucket"]).select(*_AT, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def launch_events(events: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Events inside a window of a launch of their program.

    The outermost window bounds become literals, so the scan prunes by time.
    Launches are listed under every time bucket their windows touch and events
    meet them on (program, bucket), so few candidates fail the exact bounds and a
    hot program spreads over its buckets. The list is broadcast when its counted
    size allows it.
    """
    slim = windows.select("launch_idx", "program_id", "baseline_start", "launch_ts", "evaluation_end")
    bounds = slim.agg(
        F.min("baseline_start").alias("low"),
        F.max("evaluation_end").alias("high"),
        F.max(micros(F.col("evaluation_end")) - micros(F.col("baseline_start"))).alias("span"),
    ).first()
    if bounds["low"] is None:
        events = events.where(F.lit(False))
    else:
        low, high = (F.lit(str(bounds[c])).cast("timestamp_ntz") for c in ("low", "high"))
        events = events.where((F.col("timestamp") >= low) & (F.col("timestamp") < high))
    width = max((bounds["span"] or 0) // 8, 3_600_000_000)
    first = F.floor(micros(F.col("baseline_start")) / width)
    last = F.floor((micros(F.col("evaluation_end")) - 1) / width)
    listed = slim.withColumn("bucket", F.explode(F.sequence(first, last)))
    signer = F.coalesce("signature", F.lit("")).alias("signature")
    facts = events.select(
        "program_id", "timestamp", "event_type", signer, F.floor(micros(F.col("timestamp")) / width).alias("bucket")
    )
    inside = (F.col("timestamp") >= F.col("baseline_start")) & (F.col("timestamp") < F.col("evaluation_end"))
    return facts.join(dimension(listed, limit), ["program_id", "bucket"]).where(inside)


def paired_metrics(events: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """:func:`window_metrics` by joining events with the launches whose windows hold them.

    Rows are reduced per (launch, signer) before the launch total, so a busy
    launch is summed from partial counts and distinct signers need no expand.
    """
    before = F.col("timestamp") < F.col("launch_ts")
    sent = F.col("event_type") == "transaction"
    per_signer = (
        launch_events(events, windows, limit)
        .groupBy("launch_idx", "signature")
        .agg(
            F.count_if(before).alias("b"),
            F.count_if(before & sent).alias("bt"),
            F.count_if(~before).alias("e"),
            F.count_if(~before & sent).alias("et"),
        )
    )
    totals = per_signer.groupBy("launch_idx").agg(
        F.sum("b").alias("baseline_events"),
        F.count_if(F.col("b") > 0).alias("baseline_unique_signatures"),
        F.sum("bt").alias("baseline_transactions"),
        F.sum("e").alias("evaluation_events"),
        F.count_if(F.col("e") > 0).alias("evaluation_unique_signatures"),
        F.sum("et").alias("evaluation_transactions"),
    )
    return windows.join(totals, "launch_idx", "left").fillna(0, subset=list(COUNTS))


#: Launches of a program whose windows may hold one event for events to be joined with launches.
FEW = 3


def window_metrics(events: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Six counts per launch, zeros where nothing happened.

    Where no event lies in the windows of more than FEW launches, counted on the launches alone, events are
    joined with launches, which gives at most FEW rows an event. Elsewhere no event meets a
    launch (:func:`swept_metrics`). Both give the same rows.
    """
    edges = F.array(
        F.struct(F.col("baseline_start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("evaluation_end").alias("at"), F.lit(-1).alias("step"))
    )
    moves = windows.select("program_id", F.explode(edges).alias("e")).select("program_id", "e.*")
    # Windows that end come before those that begin: both bounds are half open.
    open_now = F.sum("step").over(W.partitionBy("program_id").orderBy("at", "step").rowsBetween(W.unboundedPreceding, 0))
    most = moves.select(open_now.alias("n")).agg(F.max("n")).first()[0] or 0
    return (paired_metrics if most <= FEW else swept_metrics)(events, windows, limit)


def swept_metrics(events: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """:func:`window_metrics` without pairing events with launches.

    Plain counts in [a, b) are differences of counts before b and before a. A signer counts in [a, a + L) at
    its first event there: the one with ``before < a <= t < a + L``. So an event at t stands for the
    window starts in (max(before, t - L), t], and the distinct signers from a on are the events whose
    lower end is below a, less the events before a. All are counts of points below a probe. Points are
    made for each distinct window length, of which settings have two.
    """
    start, at, end = (micros(F.col(c)) for c in ("baseline_start", "launch_ts", "evaluation_end"))
    kept, span = _bounded(events, windows)
    lengths = [r[0] for r in windows.select(F.explode(F.array(at - start, end - at)).alias("l")).distinct().orderBy("l").collect()]
    programs = windows.select("program_id").distinct()
    facts = kept.join(dimension(programs, limit), "program_id", "left_semi").select(
        "program_id", F.coalesce("signature", F.lit("")).alias("signature"), micros(F.col("timestamp")).alias("t"),
        (F.col("event_type") == "transaction").cast("bigint").alias("sent"),
    )
    sums = ["n", "sent", *(f"d{i}" for i in range(len(lengths)))]

    def point(x: Column, **held: Column) -> Column:
        return F.struct(x.alias("x"), *[held.get(c, F.lit(0).cast("bigint")).cast("bigint").alias(c) for c in sums])

    lower = [F.greatest(F.coalesce("before", F.col("t") - l), F.col("t") - l) for l in lengths]  # noqa: E741
    made = F.array(point(F.col("t"), n=F.lit(1), sent=F.col("sent")), *[point(x, **{f"d{i}": F.lit(1)}) for i, x in enumerate(lower)])
    points = _chained(facts).select("program_id", F.explode(made).alias("p")).select("program_id", "p.*")
    edges = windows.select("program_id", F.explode(F.array(start, at, end)).alias("x")).distinct()
    below = _counts_before(points, edges, sums, max(span // BUCKETS, 60_000_000), limit)

    asked = windows.withColumns({"_0": start, "_1": at, "_2": end})
    for i in range(3):
        side = below.select("program_id", F.col("x").alias(f"_{i}"), F.struct(*sums).alias(f"_at{i}"))
        asked = asked.join(side, ["program_id", f"_{i}"], "left")

    def distinct(first: int, length: Column) -> Column:
        found = F.lit(None).cast("bigint")
        for i, l in enumerate(lengths):  # noqa: E741
            found = F.when(length == l, F.col(f"_at{first}.d{i}")).otherwise(found)
        return found - F.col(f"_at{first}.n")

    totals = {
        "baseline_events": F.col("_at1.n") - F.col("_at0.n"),
        "baseline_unique_signatures": distinct(0, F.col("_1") - F.col("_0")),
        "baseline_transactions": F.col("_at1.sent") - F.col("_at0.sent"),
        "evaluation_events": F.col("_at2.n") - F.col("_at1.n"),
        "evaluation_unique_signatures": distinct(1, F.col("_2") - F.col("_1")),
        "evaluation_transactions": F.col("_at2.sent") - F.col("_at1.sent"),
    }
    return asked.select(*windows.columns, *[F.coalesce(totals[c], F.lit(0)).alias(c) for c in COUNTS])


def judged(metrics: DataFrame, settings: Settings) -> DataFrame:
    """Ratios, signals, score, outcome and reason of each launch."""
    ratios = {
        "event_growth_ratio": ("baseline_events", "evaluation_events"),
        "unique_signer_growth_ratio": ("baseline_unique_signatures", "evaluation_unique_signatures"),
        "transaction_growth_ratio": ("baseline_transactions", "evaluation_transactions"),
    }
    with_ratios = metrics.withColumns(
        {name: growth_ratio(F.col(b), F.col(e)) for name, (b, e) in ratios.items()}
    )
    limits = (settings.event_ratio, settings.signer_ratio, settings.transaction_ratio)
    candidates = F.array(
        *[
            F.struct(
                F.lit(signal).alias("signal"),
                F.col(ratio).alias("value"),
                F.lit(float(threshold)).alias("threshold"),
                F.lit("strong").alias("impact"),
            )
            for signal, ratio, threshold in zip(SIGNALS, ratios, limits)
        ]
    )
    enough = F.col("evaluation_events") >= settings.min_events
    score = F.size("signals") + F.when(enough, F.lit(0.5)).otherwise(F.lit(0.0))
    worked = (F.col("score") >= 2.0) & enough
    return (
        with_ratios.withColumn("signals", F.filter(candidates, lambda s: s["value"] >= s["threshold"]))
        .withColumn("score", score.cast("double"))
        .withColumn("outcome", F.when(worked, "worked").otherwise("not_worked"))
        .withColumn(
            "reason",
            F.when(
                worked, "launch passed at least two growth signals with sufficient post-launch activity"
            ).otherwise("launch did not meet required signal thresholds"),
        )
    )


def backtest(events: DataFrame, launches: DataFrame, settings: Settings, limit: int | None = None) -> DataFrame:
    """Launches (launch_idx, name, program_id, launch_ts) with their verdict."""
    result = judged(window_metrics(events, launch_windows(launches, settings), limit), settings)
    return result.withColumns(
        {
            "launch_at": rfc3339(F.col("launch_ts")),
            "baseline_start": rfc3339(F.col("baseline_start")),
            "evaluation_end": rfc3339(F.col("evaluation_end")),
        }
    ).drop("launch_ts")


def has_signal(signal: str) -> Column:
    return F.exists("signals", lambda s: s["signal"] == signal)


def summary(results: DataFrame) -> DataFrame:
    worked = F.count_if(F.col("outcome") == "worked")
    return results.agg(
        F.count("*").alias("total_launches"), worked.alias("worked"), (F.count("*") - worked).alias("not_worked")
    )


def signal_leaderboard(results: DataFrame) -> DataFrame:
    """Launches showing each signal, all signals listed."""
    counts = results.agg(*[F.count_if(has_signal(s)).alias(s) for s in SIGNALS])
    listed = counts.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(s).alias("signal"), F.col(s).alias("wins_in_launch")) for s in SIGNALS]
            )
        ).alias("r")
    ).select("r.*")
    return listed.orderBy(F.desc("wins_in_launch"), "signal")


def _history_row(results: DataFrame) -> DataFrame:
    worked = F.col("outcome") == "worked"
    aggs = [F.count("*").alias("n"), F.count_if(worked).alias("worked")]
    for s in SIGNALS:
        aggs += [F.count_if(has_signal(s)).alias(f"{s}_total"), F.count_if(has_signal(s) & worked).alias(f"{s}_worked")]
    return results.agg(*aggs)


def signal_performance(results: DataFrame) -> DataFrame:
    """Coverage and precision of each signal over the judged launches."""
    row = _history_row(results)
    prior = F.when(F.col("n") > 0, F.col("worked") / F.col("n")).otherwise(F.lit(0.0))

    def entry(s: str) -> Column:
        total, worked = F.col(f"{s}_total"), F.col(f"{s}_worked")
        return F.struct(
            F.lit(s).alias("signal"),
            F.when(total > 0, worked / total).otherwise(prior).alias("precision"),
            F.when(F.col("n") > 0, total / F.col("n")).otherwise(F.lit(0.0)).alias("coverage"),
            worked.alias("worked_with_signal"),
            total.alias("total_with_signal"),
        )

    return row.select(F.explode(F.array(*[entry(s) for s in SIGNALS])).alias("r")).select("r.*")


@dataclass(frozen=True)
class History:
    """What scoring needs to know of past launches: one small row."""

    n: int
    worked: int
    totals: tuple[int, ...]
    hits: tuple[int, ...]

    @staticmethod
    def of(results: DataFrame) -> "History":
        row = _history_row(results).first()
        if row["n"] < 3:
            raise ValueError("scoring needs at least 3 past launches")
        return History(
            row["n"],
            row["worked"],
            tuple(row[f"{s}_total"] for s in SIGNALS),
            tuple(row[f"{s}_worked"] for s in SIGNALS),
        )

    @property
    def prior(self) -> float:
        return self.worked / self.n

    def coverage(self, i: int) -> float:
        return self.totals[i] / self.n

    def precision(self, i: int) -> float:
        return self.hits[i] / self.totals[i] if self.totals[i] else self.prior


def score_launches(history: DataFrame, candidates: DataFrame, settings: Settings) -> DataFrame:
    """Probability, band, confidence and ranked contributions of judged candidates."""
    past = History.of(history)
    prior = F.lit(past.prior)
    parts = [
        F.struct(
            F.lit(s).alias("signal"),
            contribution(F.lit(past.precision(i)), prior, F.lit(past.coverage(i)), has_signal(s)).alias("contribution"),
            has_signal(s).alias("candidate_triggered"),
            F.lit(past.precision(i)).alias("precision"),
            F.lit(past.coverage(i)).alias("coverage"),
            F.lit(past.hits[i]).alias("worked_with_signal"),
            F.lit(past.totals[i]).alias("total_with_signal"),
        )
        for i, s in enumerate(SIGNALS)
    ]
    enough = F.col("evaluation_events") >= settings.min_events
    raw = prior
    for i in range(len(SIGNALS)):
        raw = raw + F.col("parts")[i]["contribution"]
    raw = raw - F.when(enough, F.lit(0.0)).otherwise(F.lit(0.1))
    raw = raw + F.when(F.col("score") >= 2.0, F.lit(0.05)).otherwise(F.lit(0.0))
    average = sum(past.coverage(i) for i in range(len(SIGNALS))) / len(SIGNALS)
    confidence = (
        F.lit(0.35)
        + F.lit(min(1.0, past.n / 20.0)) * F.lit(0.35)
        + F.lit(average) * F.lit(0.2)
        + F.when(enough, F.lit(0.1)).otherwise(F.lit(0.0))
    )

    def stronger(a: Column, b: Column) -> Column:
        left, right = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (
            F.when(left > right, -1).when(left < right, 1)
            .when(a["signal"] < b["signal"], -1).when(a["signal"] > b["signal"], 1).otherwise(0)
        )

    return (
        candidates.withColumn("parts", F.array(*parts))
        .withColumn("prior_probability", prior)
        .withColumn("probability", clamp(raw, 0.01, 0.99))
        .withColumn("probability_band", probability_band(F.col("probability")))
        .withColumn("confidence", clamp(confidence, 0.05, 0.95))
        .withColumn("top_signals", F.array_sort("parts", stronger))
        .drop("parts")
    )
