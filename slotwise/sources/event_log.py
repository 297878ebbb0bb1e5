"""The append-only event log and its sibling tables as partitioned parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import IDENTIFIER
from ..operators.history import utc_bound


def checked_table_name(name: str = "chain_events") -> str:
    import re

    if not re.match(IDENTIFIER.replace(r"\z", r"\Z"), name):
        raise ValueError(f"invalid table name {name!r}")
    return name


def scan_table(spark: SparkSession, name: str = "chain_events") -> DataFrame:
    """The event table under its configured name."""
    return spark.table(checked_table_name(name))


def by_day(events: DataFrame) -> DataFrame:
    """Event-log rows laid out for a write by day, each file sorted by (timestamp, event_id).

    Range partitioning on the sort key cuts a busy day into several even files.
    """
    return (
        events.withColumn("event_date", F.to_date("timestamp"))
        .repartitionByRange("timestamp", "event_id")
        .sortWithinPartitions("event_date", "timestamp", "event_id")
    )


def append_events(events: DataFrame, path: str) -> None:
    by_day(events).write.mode("append").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str, start: str = "", end: str = "") -> DataFrame:
    """Read the log; time bounds [start, end) prune days and row groups."""
    schema = schemas.T.StructType(schemas.EVENT_LOG.fields + [schemas.T.StructField("event_date", schemas.T.DateType())])
    events = spark.read.schema(schema).parquet(path)
    if start:
        events = events.where((F.col("event_date") >= F.to_date(utc_bound(start))) & (F.col("timestamp") >= utc_bound(start)))
    if end:
        events = events.where((F.col("event_date") <= F.to_date(utc_bound(end))) & (F.col("timestamp") < utc_bound(end)))
    return events.drop("event_date")


def append_audit(rows: DataFrame, path: str) -> None:
    """Append evaluations by day, so that a purge can drop whole days."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    schema = schemas.T.StructType(schemas.AUDIT.fields + [schemas.T.StructField("day", schemas.T.DateType())])
    return spark.read.schema(schema).parquet(path).drop("day")


#: Stands in a purge's copy of a day once the copy is whole; only then may the day be touched.
_WHOLE = "_whole"


def purge_audit(
    spark: SparkSession, path: str, now: str, retention_hours: int = 720, after: Callable[[str], None] = lambda step: None
) -> None:
    """Delete the audit rows older than the retention, by day.

    Whole days before the edge go as folders, and only the edge's own day is written again, from a copy
    of its kept rows beside the log. The copy counts once its marker stands in it. A purge may stop
    after any step and the next one, with whatever edge, first ends what it left: a copy with its marker
    replaces its day again, one without is dropped, as its day was not touched yet. The marker goes before
    the copy does. No rename has to be atomic. ``after`` is told each step that is done.
    """
    from ..operators.monitors import retention_edge

    edge = retention_edge(now, retention_hours)
    first = spark.range(1).select(F.to_date(edge).cast("string").alias("day")).first()["day"]
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(path.rstrip("/"))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = f"{root.getName()}-purged-"

    def replace_day(copy, day: str) -> None:
        spark.read.schema(schemas.AUDIT).parquet(copy.toString()).write.mode("overwrite").parquet(f"{path}/day={day}")
        after("day replaced")
        fs.delete(files.Path(copy, _WHOLE), False)
        after("marker gone")
        fs.delete(copy, True)
        after("copy gone")

    # A copy at most, unless purges ran at the same time.
    for left in fs.listStatus(root.getParent()):
        copy = left.getPath()
        if copy.getName().startswith(prefix):
            if fs.exists(files.Path(copy, _WHOLE)):
                replace_day(copy, copy.getName().removeprefix(prefix))
            else:
                fs.delete(copy, True)
    # One entry for each day kept.
    days = {s.getPath().getName(): s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=")}
    if f"day={first}" in days:
        copy = files.Path(root.getParent(), prefix + first)
        kept = spark.read.schema(schemas.AUDIT).parquet(f"{path}/day={first}").where(F.col("created_at") >= edge)
        kept.write.mode("overwrite").parquet(copy.toString())
        after("copy written")
        fs.create(files.Path(copy, _WHOLE), True).close()
        after("marker set")
        replace_day(copy, first)
    for name, folder in sorted(days.items()):
        if name < f"day={first}":
            fs.delete(folder, True)
            after("day dropped")


def rewrite(df: DataFrame, path: str) -> DataFrame:
    """Write a table's next version into a new folder and read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
