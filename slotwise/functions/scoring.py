"""Launch and report scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Signal names in their fixed order.
SIGNALS = ("event_growth", "unique_signer_growth", "transaction_growth")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def growth_ratio(baseline: Column, evaluation: Column) -> Column:
    b, e = baseline.cast("double"), evaluation.cast("double")
    return F.when(b > 0, e / b).when(e <= 0, F.lit(1.0)).otherwise(e)


def probability_band(p: Column) -> Column:
    return F.when(p >= 0.75, "high").when(p >= 0.45, "medium").otherwise("low")


def contribution(precision: Column, prior: Column, coverage: Column, triggered: Column) -> Column:
    delta = precision - prior
    fired = delta * (F.lit(0.6) + F.lit(0.4) * coverage)
    silent = -delta * F.lit(0.25) * coverage
    # Adding zero turns a negative zero into zero.
    return F.when(triggered, fired).otherwise(silent) + F.lit(0.0)


def threshold_met(value: Column, comparator: Column, threshold: Column) -> Column:
    """gt, gte, lt or lte; NULL for any other comparator."""
    name = F.lower(strip(comparator))
    return (
        F.when(name == "gt", value > threshold)
        .when(name == "gte", value >= threshold)
        .when(name == "lt", value < threshold)
        .when(name == "lte", value <= threshold)
    )


def report_verdict(prompt: Column, n_rows: Column, n_kpis: Column, first_kpi: Column) -> Column:
    text = F.lower(prompt)
    falling = text.contains("drop") | text.contains("decrease") | text.contains("decline")
    return (
        F.when(n_rows == 0, "insufficient_data")
        .when(n_kpis == 0, "watch")
        .when(first_kpi <= 0, "critical")
        .when(falling & (first_kpi < 1), "critical")
        .when(falling & (first_kpi < 10), "watch")
        .when(falling, "healthy")
        .when(first_kpi < 1, "watch")
        .otherwise("healthy")
    )


def report_confidence(n_rows: Column, n_kpis: Column) -> Column:
    def bonus(cond: Column, points: float) -> Column:
        return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))

    total = (
        F.lit(0.45)
        + bonus(n_rows > 0, 0.2)
        + bonus(n_rows >= 5, 0.1)
        + bonus(n_kpis > 0, 0.2)
        + bonus(n_kpis >= 3, 0.05)
    )
    return F.least(total, F.lit(0.95))


def suggested_comparator(prompt: Column) -> Column:
    text = F.lower(prompt)
    rising = text.contains("increase") | text.contains("spike") | text.contains("up")
    return F.when(rising, "gt").otherwise("lt")


def suggested_threshold(prompt: Column, first_numeric: Column) -> Column:
    scaled = F.when(suggested_comparator(prompt) == "lt", first_numeric * 0.7).otherwise(first_numeric * 1.3)
    return F.coalesce(scaled, F.lit(0.0))
