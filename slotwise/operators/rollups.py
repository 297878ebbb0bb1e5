"""Hourly rollups whose distinct counts merge: written once, they answer any window of whole hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dimension

#: Logarithm of a sketch's registers: 4,096 of them, a relative standard error of 1.6 %.
LG_K = 12


def hourly_rollup(events: DataFrame) -> DataFrame:
    """(program_id, hour, events, transactions, signers): counts, and a sketch of the distinct signers.

    Counts and sketches combine before the shuffle. A missing signature is one signer, the empty text.
    """
    # Sketches pass over empty texts, so every signer carries a mark.
    signer = F.concat(F.lit("="), F.coalesce("signature", F.lit("")))
    return events.groupBy("program_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "transaction").alias("transactions"),
        F.hll_sketch_agg(signer, F.lit(LG_K)).alias("signers"),
    )


def windows_from_rollup(rollup: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (program_id, window_start, window_end on whole hours, ...) with events and transactions, exact, and
    signers, estimated by the union of the hours' sketches. Windows without events have zeros.

    A window reads its hours' rows, not events: at most as many rows as it has hours.
    """
    hours = F.sequence("window_start", F.col("window_end") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    asked = windows.select("program_id", "window_start", "window_end").distinct()
    listed = asked.where("window_start < window_end").select("*", F.explode(hours).alias("hour"))
    found = listed.join(dimension(rollup), ["program_id", "hour"]).groupBy("program_id", "window_start", "window_end").agg(
        F.sum("events").alias("events"), F.sum("transactions").alias("transactions"),
        F.hll_sketch_estimate(F.hll_union_agg("signers")).alias("signers"),
    )
    return windows.join(found, ["program_id", "window_start", "window_end"], "left").fillna(0, subset=["events", "transactions", "signers"])
