"""Streaming jobs: raw updates in; event log, topic, outbox, dead letters and metrics out.

Each micro-batch writes into a folder of its own number and overwrites it when
retried, so a restarted job neither loses nor repeats rows.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dead_letters as dl
from ..operators import fanout, normalize
from ..schemas import RAW_ACCOUNT, RAW_TRANSACTION
from ..sources.event_log import by_day
from ..sources.json_rows import dead_letter_rows, read_dead_letters

_LOG = logging.getLogger(__name__)
#: The sinks hold an event's JSON several times over; they compress to well under the default codec's size.
CODEC = "zstd"

UPDATE = T.StructType(
    [T.StructField("transaction", RAW_TRANSACTION), T.StructField("account", RAW_ACCOUNT)]
)


def update_lines(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Raw updates as JSON texts, the shape a topic carries."""
    tx = F.struct(*[F.col(f.name) for f in RAW_TRANSACTION.fields])
    acc = F.struct(*[F.col(f.name) for f in RAW_ACCOUNT.fields])
    return transactions.select(F.to_json(F.struct(tx.alias("transaction"))).alias("value")).unionByName(
        accounts.select(F.to_json(F.struct(acc.alias("account"))).alias("value"))
    )


def parse_updates(lines: DataFrame) -> DataFrame:
    """Transaction and account updates; every other kind is ignored."""
    parsed = lines.select(F.from_json("value", UPDATE).alias("u")).select("u.*")
    return parsed.where("transaction IS NOT NULL OR account IS NOT NULL")


def file_updates(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_updates(lines)


def kafka_updates(spark: SparkSession, servers: str, topic: str, rows_per_batch: int = 5_000_000) -> DataFrame:
    """The same stream from a topic; needs the Kafka connector on the cluster."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", rows_per_batch)
        .load()
    )
    return parse_updates(raw.select(F.col("value").cast("string").alias("value")))


def kafka_sink(records: DataFrame, servers: str, topic: str):
    return records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def normalize_updates(updates: DataFrame, registry: DataFrame) -> DataFrame:
    transactions = updates.where("transaction IS NOT NULL").select("transaction.*")
    accounts = updates.where("account IS NOT NULL").select("account.*")
    return normalize.normalize_transactions(transactions, registry).unionByName(
        normalize.normalize_accounts(accounts, registry)
    )


def accepted_by_topic(records: DataFrame) -> DataFrame:
    """Outcome of a topic that takes every record."""
    return records.withColumn("error", F.lit(None).cast("string"))


@dataclass
class Ingest:
    """One micro-batch at a time through every sink.

    ``registry`` and ``routes`` are read again for each batch. A load that passes its
    checks is written to a numbered folder and used from there; when a load fails the
    copy of the last good one stays in use, whatever became of its source.

    ``publish`` gets normalised events with their record (``key``, ``value``) once per batch
    and gives them back with ``error``: NULL once the record is in the topic, else why
    the last attempt failed. Failed events become dead letters.
    """

    registry: Callable[[], DataFrame]
    routes: Callable[[], DataFrame] | None
    out: str
    static_url: str | None = None
    publish: Callable[[DataFrame], DataFrame] = accepted_by_topic
    _kept: dict = field(default_factory=dict)

    def _fresh(self, name: str, load: Callable[[], DataFrame], batch_id: int) -> DataFrame:
        path = f"{self.out}/kept/{name}-{batch_id}-{uuid.uuid4().hex[:8]}"
        try:
            table = load()
            table.write.parquet(path, compression=CODEC)
            self._kept[name] = table.sparkSession.read.schema(table.schema).parquet(path)
        except PySparkException as failure:
            if name not in self._kept:
                raise
            _LOG.warning("the last good copy of %s stays in use: %s", name, failure)
        return self._kept[name]

    def _save(self, df: DataFrame, sink: str, batch_id: int) -> DataFrame:
        path = f"{self.out}/{sink}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path, compression=CODEC)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __call__(self, updates: DataFrame, batch_id: int) -> None:
        registry = self._fresh("registry", lambda: normalize.load_registry(self.registry()), batch_id)
        # Written once; every sink reads the written rows, not the join again.
        events = self._save(normalize_updates(updates, registry), "normalized", batch_id)
        by_day(normalize.event_log_rows(events)).write.mode("overwrite").partitionBy("event_date").parquet(
            f"{self.out}/event_log/batch_id={batch_id}", compression=CODEC
        )
        key, value = normalize.record_parts(events.columns)
        outcome = self._save(self.publish(events.withColumn("key", key).withColumn("value", value)), "publish_outcome", batch_id)
        failed = outcome.where("error IS NOT NULL")
        self._save(outcome.where("error IS NULL").select("key", "value"), "topic", batch_id)
        letters = dead_letter_rows(failed, F.col("observed_at_unix_ms"), F.col("error"))
        letters.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(
            "overwrite"
        ).text(f"{self.out}/dead_letters/batch_id={batch_id}")
        metrics = outcome.agg(
            F.count("*").alias("events_total"),
            F.count_if(F.col("error").isNull()).alias("published_total"),
            F.count_if(F.col("error").isNotNull()).alias("publish_failures_total"),
            F.coalesce(F.max("observed_at_unix_ms"), F.lit(0)).alias("last_event_observed_ms"),
        )
        self._save(metrics, "metrics", batch_id)
        if self.routes is not None:
            routes = self._fresh("routes", lambda: normalize.load_routes(self.routes()), batch_id)
            matched = fanout.matched_routes(events, routes, self.static_url, unique_urls=True)
            self._save(matched, "outbox", batch_id)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available now, then stop."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replay_dead_letters(
    spark: SparkSession,
    path: str,
    out: str,
    publish: Callable[[DataFrame], DataFrame],
    size: int = dl.REPLAY_BATCH,
) -> DataFrame:
    """One bounded replay: publish the oldest letters, write the rest as the next version.

    ``publish`` gives back the letters that went through and runs once: batch and outcome
    are written beside ``out`` (``-batch``, ``-replayed``) and read from there. The old
    folder is left as it is; the caller points to the new one.
    """
    letters = read_dead_letters(spark, path)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{out}-{name}")
        return spark.read.schema(df.schema).parquet(f"{out}-{name}")

    batch = written(dl.replay_batch(letters, size), "batch")
    done = written(publish(batch.where("event IS NOT NULL")), "replayed")
    dl.remaining(letters, done).select(F.col("raw").alias("value")).write.text(out)
    return dl.backlog(letters, batch, done)
