"""Windowed counts: a stream of shuffled files gives the batch result; late rows beyond the delay do not count."""

import random

from pyspark.sql import functions as F

from slotwise.session import workspace
from slotwise.streaming import windows

SCHEMA = "program_id string, s long, event_type string"


def _events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "program_id", "event_type", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS timestamp"
    )


def _streamed(spark, parts, apply):
    path = workspace(spark, "windows")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        made = apply(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


def test_stream_equals_batch_inside_the_delay(spark):
    r = random.Random(3)
    rows = [(r.choice("PQ"), r.randrange(20_000), r.choice(["transaction", "account"])) for _ in range(600)]
    # Rows arrive up to 3000 s late; the last row ends all windows but its own.
    arrived = sorted(rows, key=lambda x: x[1] + r.randrange(3000))
    parts = [_events(spark, arrived[i:i + 150]) for i in range(0, 600, 150)]
    end = _events(spark, [("Z", 900_000, "transaction")])
    for apply in (
        lambda df: windows.events_per_window(df, "10 minutes", delay_ms=3_000_000),
        lambda df: windows.events_per_window(df, "10 minutes", "5 minutes", delay_ms=3_000_000),
        lambda df: windows.events_per_session(df, "100 seconds", delay_ms=3_000_000),
    ):
        got = _streamed(spark, [*parts, end], apply)
        want = apply(_events(spark, rows))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert want.agg(F.sum("events")).first()[0] >= 600


def test_rows_beyond_the_delay_are_dropped(spark):
    parts = [_events(spark, [("P", 10_000, "transaction")]), _events(spark, [("P", 20, "account"), ("P", 9_990, "account")]), _events(spark, [("Z", 900_000, "x")])]
    got = _streamed(spark, parts, lambda df: windows.events_per_window(df, "10 minutes", delay_ms=600_000)).collect()
    assert [(r.program_id, r.events, r.transactions) for r in got] == [("P", 2, 1)]
