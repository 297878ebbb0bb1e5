"""The ordered rule of :mod:`slotwise.operators.ordered_rules` on a stream, in Spark's keyed state.

Rows may arrive out of order by up to the watermark's delay. Keys are dealt by their hash to ``BUCKETS``
buckets, so calls and state reads grow with buckets and not with keys. A bucket holds its keys' rows that the
watermark has not passed, and each key's last accepted row (time, mark, rows since). An event-time timer at
the earliest waiting row decides all rows the watermark has passed, in order of time, with the batch
rule's own loop; decisions leave with the micro-batch that the watermark passed them in. A key without
waiting rows is dropped at the end of its last accepted row's quiet and repeat spans: by event time, not by the
clock of the job. A retried micro-batch starts from the state store's version before it.

A row older than the watermark, or without a time, is late: it comes out at once with null decisions and
changes none. (Spark itself would drop such rows; the watermark's column is left out of what the
operator reads, so that they reach it.)

A bucket's waiting rows and live keys are in one task's memory, as keyed state is: the delay and the spans bound
them. The number of buckets stays the same for a checkpoint's life. The state store is RocksDB, so the state
of all buckets is bounded by disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ordered_rules import _decide_keys, rule_rows

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a row without one; before any watermark.
NO_TIME = -(1 << 62)
#: Buckets of keys; a checkpoint keeps the number it began with.
BUCKETS = 1024
#: Waiting rows of a bucket as they came, and its keys' last accepted rows: Arrow streams.
_STATE = "rows binary"
_WAITING = pa.schema([("k", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("quiet", pa.int64()), ("repeat", pa.int64()), ("mark", pa.string()), ("payload", pa.string())])
_LAST = pa.schema([("k", pa.string()), ("at", pa.int64()), ("mark", pa.string()), ("n", pa.int64()), ("span", pa.int64())])
_OUT = "payload string, accepted boolean, anchor_at long, position long"


def _stored(rows: list[tuple], schema: pa.Schema) -> bytes:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_arrays(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def _held(stored: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(stored)).read_all().columns)))


class QuietRule(StatefulProcessor):
    """Rows (k, at, tie, quiet, repeat, mark, payload) of a bucket of keys; gives payloads with their decisions."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = []
        for part in rows:
            late = (part["at"] == NO_TIME) | (part["at"] < passed if passed > 0 else False)
            if late.any():
                yield pd.DataFrame({"payload": part["payload"][late], "accepted": None, "anchor_at": None, "position": None})
            part = part[~late]
            k = [None if pd.isna(v) else v for v in part["k"]]
            came += zip(k, *(part[c].tolist() for c in _WAITING.names[1:]))
        if came:
            self.waiting.appendValue((_stored(came, _WAITING),))
            wake = min(r[1] for r in came) // 1000 + 1
            # One timer a bucket.
            for timer in list(self.handle.listTimers()):
                at = timer[0] if isinstance(timer, tuple) else timer
                if at <= wake:
                    return
                self.handle.deleteTimer(at)
            self.handle.registerTimer(wake)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for part in self.waiting.get() for r in _held(part[0])]
        due = [r for r in held if r[1] < passed]
        states = {r[0]: r[1:] for r in _held(self.last.get()[0])} if self.last.exists() else {}
        if due:
            due.sort(key=lambda r: (r[0] is not None, r[0] or "", *r[1:]))
            k, at, _, quiet, repeat, mark, payload = zip(*due)
            left = {key: state[:3] for key, state in states.items()}
            accepted, anchor, position = _decide_keys(k, at, mark, quiet, repeat, left)
            spans = {r[0]: max(r[3], r[4]) for r in due}
            states |= {key: (*left[key], span) for key, span in spans.items()}
            yield pd.DataFrame({"payload": payload, "accepted": accepted, "anchor_at": anchor, "position": position})
        rest = [r for r in held if r[1] >= passed]
        waits = {r[0] for r in rest}
        live = [(k, *state) for k, state in states.items() if k in waits or state[0] + state[3] >= passed]
        if due:
            if rest:
                self.waiting.put([(_stored(rest, _WAITING),)])
            else:
                self.waiting.clear()
        if live:
            if due or len(live) < len(states):
                self.last.update((_stored(live, _LAST),))
        elif states:
            self.last.clear()
        ends = [r[1] + r[4] for r in live if r[0] not in waits]
        if rest or ends:
            self.handle.registerTimer(min([*ends, *(r[1] for r in rest)]) // 1000 + 1)

    def close(self) -> None:
        pass


def _packed(fields: list[T.StructField], row: str) -> Column:
    """The row's columns as texts under their places, so that any names and nulls pass through the state."""
    return F.to_json(F.struct(*[F.col(f"{row}.`{f.name}`").cast("string").alias(f"c{i}") for i, f in enumerate(fields)]))


def quiet_stream(
    rows: DataFrame, key: Column, at_us: Column, tie: Column, quiet_us: Column, repeat_us: Column | None = None,
    mark: Column | None = None, delay_ms: int = 0,
) -> DataFrame:
    """``apply_quiet_rule`` of a stream: the input's columns with accepted, anchor_at and position, null for late rows.

    Columns are numbers, texts, booleans, dates or times. Output mode is append.
    """
    base = rule_rows(rows, key, at_us, tie, quiet_us, repeat_us, mark)
    fields = base.schema["row"].dataType.fields
    kept = base.select(
        F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).alias("bucket"), "k", F.coalesce("at", F.lit(NO_TIME)).alias("at"), F.coalesce("tie", F.lit(0)).alias("tie"), "quiet", "repeat", "mark",
        _packed(fields, "row").alias("payload"), F.timestamp_micros("at").alias("_time"),
    ).withWatermark("_time", f"{int(delay_ms)} milliseconds").drop("_time")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    made = kept.groupBy("bucket").transformWithStateInPandas(QuietRule(), _OUT, "Append", "EventTime")
    texts = F.from_json("payload", T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))]))
    made = made.select(texts.alias("_row"), "accepted", "anchor_at", "position")
    return made.select(
        *[F.col(f"_row.c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)], "accepted", "anchor_at", "position"
    )


def streamed(delay_ms: int) -> Callable[..., DataFrame]:
    """A drop-in for ``apply_quiet_rule`` on a stream."""

    def rule(*columns, **tuning) -> DataFrame:
        return quiet_stream(*columns, **tuning, delay_ms=delay_ms)

    return rule
