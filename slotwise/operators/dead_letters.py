"""Bounded replay of dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters per replay run and the backlog that raises an alert.
REPLAY_BATCH = 200
ALERT_BACKLOG = 200


def replay_batch(letters: DataFrame, size: int = REPLAY_BATCH) -> DataFrame:
    """Oldest letters first; lines that do not parse use up places, as they would in the file."""
    return letters.orderBy(F.col("failed_at_unix_ms").asc_nulls_first(), "raw").limit(size)


def remaining(letters: DataFrame, replayed: DataFrame) -> DataFrame:
    """Lines left after a replay: failed, unparsable and beyond the batch.

    Equal lines are counted, so a second copy of a replayed line stays.
    """
    return letters.select("raw").exceptAll(replayed.select("raw"))


def backlog(letters: DataFrame, batch: DataFrame, replayed: DataFrame, threshold: int = ALERT_BACKLOG) -> DataFrame:
    """Processed, replayed and remaining counts and whether to alert."""
    left = remaining(letters, replayed).agg(F.count("*").alias("n"))
    counts = (
        batch.agg(F.count("*").alias("n")).withColumn("kind", F.lit("processed"))
        .unionByName(replayed.agg(F.count("*").alias("n")).withColumn("kind", F.lit("replayed")))
        .unionByName(left.withColumn("kind", F.lit("remaining")))
    )

    def pick(kind: str):
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    return counts.agg(
        pick("processed").alias("processed"), pick("replayed").alias("replayed"), pick("remaining").alias("remaining"),
        (pick("remaining") >= threshold).alias("alert"),
    )
