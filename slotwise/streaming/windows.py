"""Event counts per program and time window, on a table or on a stream.

On a stream a window comes out once, when the watermark has passed its end; rows that
come later than the delay allows are dropped by Spark. Counts are combined before the shuffle,
sessions too, so a busy program sends one partial row per window and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, delay_ms: int) -> DataFrame:
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", f"{int(delay_ms)} milliseconds") if events.isStreaming else timed


def _counted(events: DataFrame, window) -> DataFrame:
    sent = F.col("event_type") == "transaction"
    made = events.groupBy("program_id", window.alias("w")).agg(F.count("*").alias("events"), F.count_if(sent).alias("transactions"))
    return made.select("program_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "transactions")


def events_per_window(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay_ms: int = 0) -> DataFrame:
    """Counts per program and tumbling window, or sliding one with ``slide``. Windows without events have no row."""
    return _counted(_timed(events, delay_ms), F.window("timestamp", width, slide))


def events_per_session(events: DataFrame, gap: str = "30 minutes", delay_ms: int = 0) -> DataFrame:
    """Counts per program and session: events no further apart than ``gap``; it ends ``gap`` after its last event."""
    return _counted(_timed(events, delay_ms), F.session_window("timestamp", gap))
