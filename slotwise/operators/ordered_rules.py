"""Rules that depend on what was accepted before, per key and in time order.

A row of a key is *accepted* when nothing was accepted before it, or when the
last accepted row is at least ``quiet_us`` old and either its mark differs or it
is at least ``repeat_us`` old. Rate windows, alert cool-down, alert
de-duplication and nonce replay are all this one rule.

Keys with few rows are dealt by their hash to buckets of a bounded number of rows, and a bucket's
keys are marked in one call: the number of keys costs no calls.

One key may own a large share of all rows, so the rows of a key with many are not handed to one
task. Time is cut into chunks of whole quiet periods holding a bounded number
of rows. What a chunk does to any incoming state is fixed by the few rows at its
start, so each chunk is reduced to a small entry table; tables are combined in
a tree (``FAN_IN`` at a time), the state entering every chunk follows, and a
last pass marks the rows chunk by chunk.

A key with more rows in one quiet period than a chunk may hold goes another way. Its rows are cut in
order into zones of about a chunk's rows, each known by its times, marks and rows. Few rows of a
period are accepted, so from a state the next zone that can hold an accepted row is looked up in the zone map,
and only that zone's rows are read to find the state it leaves: a round for each zone with accepted
rows, all such keys at a time. Every zone's entering state follows, and zones are marked in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import minutes_us
from ..session import workspace

FAN_IN = 64
CHUNK_ROWS = 1_000_000
#: Keys of up to this part of a chunk's rows go to buckets, which hold this part of a chunk's rows on average.
KEY_PART, BUCKET_PART = 4, 16
MAX_PERIODS = 4096

_TABLE = (
    "k string, chunk long, pos long, entry_at long, entry_mark string, "
    "exit_at long, exit_mark string, exit_n long, total long, quiet long, repeat long, start long"
)
_CARRY = "k string, chunk long, c_at long, c_mark string, c_n long"


def _run_ends(mark: np.ndarray) -> np.ndarray:
    """For every row the index of the next row with another mark."""
    n = len(mark)
    ends = np.empty(n, dtype=np.int64)
    if n:
        change = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        bounds = np.append(change, n)
        ends[:] = bounds[np.searchsorted(change, np.arange(n), side="right")]
    return ends


def _next_index(at, mark, ends, s_at, s_mark, quiet, repeat, floor):
    """First acceptable row for each state (s_at, s_mark), len(at) when none."""
    n = len(at)
    first = np.maximum(np.searchsorted(at, s_at + max(quiet, 0), side="left"), floor)
    if repeat <= quiet:
        return first
    inside = np.minimum(first, max(n - 1, 0))
    same = (first < n) & (mark[inside] == s_mark) & (s_mark != "")
    later = np.maximum(np.searchsorted(at, s_at + repeat, side="left"), first)
    return np.where(same, np.minimum(ends[inside], later), first)


def _links(at, mark, quiet, repeat):
    """Next accepted row after each row, were that row accepted."""
    floor = np.arange(len(at), dtype=np.int64) + 1
    return _next_index(at, mark, _run_ends(mark), at, mark, quiet, repeat, floor)


def _last_in_chain(nxt: np.ndarray) -> np.ndarray:
    n = len(nxt)
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _entry_rows(at: np.ndarray, start: int, span: int) -> int:
    """Rows that can be the first accepted one after a state from before start."""
    return min(int(np.searchsorted(at, start + span, side="left")) + 1, len(at))


def _chunk_table(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "tie"], kind="stable")
    at = pdf["at"].to_numpy(np.int64)
    mark = pdf["mark"].to_numpy(object)
    quiet, repeat, start = (int(pdf[c].iloc[0]) for c in ("quiet", "repeat", "start"))
    last = _last_in_chain(_links(at, mark, quiet, repeat))
    m = _entry_rows(at, start, max(quiet, repeat, 0))
    out = last[:m]
    return pd.DataFrame(
        {
            "k": pdf["k"].iloc[0],
            "chunk": pdf["chunk"].iloc[0],
            "pos": np.arange(m),
            "entry_at": at[:m],
            "entry_mark": mark[:m],
            "exit_at": at[out],
            "exit_mark": mark[out],
            "exit_n": len(at) - out,
            "total": len(at),
            "quiet": quiet,
            "repeat": repeat,
            "start": start,
        }
    )


class _Table:
    """Entry table of one chunk, ready to move states across it."""

    def __init__(self, pdf: pd.DataFrame):
        self.at = pdf["entry_at"].to_numpy(np.int64)
        self.mark = pdf["entry_mark"].to_numpy(object)
        self.exit_at = pdf["exit_at"].to_numpy(np.int64)
        self.exit_mark = pdf["exit_mark"].to_numpy(object)
        self.exit_n = pdf["exit_n"].to_numpy(np.int64)
        self.chunk, self.total, self.quiet, self.repeat, self.start = (
            int(pdf[c].iloc[0]) for c in ("chunk", "total", "quiet", "repeat", "start")
        )
        self.ends = _run_ends(self.mark)

    def move(self, at, mark, n):
        nxt = _next_index(self.at, self.mark, self.ends, at, mark, self.quiet, self.repeat, 0)
        hit = nxt < len(self.at)
        i = np.minimum(nxt, len(self.at) - 1)
        return (
            np.where(hit, self.exit_at[i], at),
            np.where(hit, self.exit_mark[i], mark),
            np.where(hit, self.exit_n[i], n + self.total),
        )


def _children(pdf: pd.DataFrame) -> list[_Table]:
    pdf = pdf.sort_values(["chunk", "pos"])
    return [_Table(part) for _, part in pdf.groupby("chunk", sort=True)]


def _merged_table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry table of a run of chunks taken as one."""
    tables = _children(pdf)
    first = tables[0]
    limit = first.start + max(first.quiet, first.repeat, 0)
    rows = []
    for i, table in enumerate(tables):
        at, mark, n = table.exit_at, table.exit_mark, table.exit_n
        if i:  # only the first row can matter: an earlier state is old by then
            at, mark, n = at[:1], mark[:1], n[:1]
        entry_at, entry_mark = table.at[: len(at)], table.mark[: len(at)]
        for follower in tables[i + 1 :]:
            at, mark, n = follower.move(at, mark, n)
        rows.append((entry_at, entry_mark, at, mark, n))
        if table.at[len(entry_at) - 1] >= limit:
            break
    cols = [np.concatenate(c) for c in zip(*rows)]
    return pd.DataFrame(
        {
            "k": key[0],
            "chunk": key[1],
            "pos": np.arange(len(cols[0])),
            "entry_at": cols[0],
            "entry_mark": cols[1],
            "exit_at": cols[2],
            "exit_mark": cols[3],
            "exit_n": cols[4],
            "total": sum(t.total for t in tables),
            "quiet": first.quiet,
            "repeat": first.repeat,
            "start": first.start,
        }
    )


def _walk(key: str, tables: list[_Table], state: tuple | None) -> pd.DataFrame:
    """State entering each chunk, given the state entering the first."""
    rows = []
    for table in tables:
        rows.append((key, table.chunk) + (state or (None, None, None)))
        if state is None:
            state = (int(table.exit_at[0]), table.exit_mark[0], int(table.exit_n[0]))
        else:
            at, mark, n = table.move(
                np.array([state[0]]), np.array([state[1]], dtype=object), np.array([state[2]])
            )
            state = (int(at[0]), mark[0], int(n[0]))
    out = pd.DataFrame(rows, columns=["k", "chunk", "c_at", "c_mark", "c_n"])
    return out.astype({"c_at": "Int64", "c_n": "Int64"})


def _top_walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return _walk(key[0], _children(pdf), None)


def _down_walk(key: tuple, pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    if pdf.empty:
        return pd.DataFrame(columns=["k", "chunk", "c_at", "c_mark", "c_n"])
    return _walk(key[0], _children(pdf), _state(carry))


def _state(carry: pd.DataFrame) -> tuple | None:
    if carry.empty or pd.isna(carry["c_at"].iloc[0]):
        return None
    row = carry.iloc[0]
    return int(row["c_at"]), row["c_mark"], int(row["c_n"])


def _decide(at, mark, quiet: int, repeat: int, state: tuple | None):
    """accepted, anchor_at and position of sorted rows, given the state before them."""
    n = len(at)
    links = _links(at, mark, quiet, repeat).tolist()
    if state is None:
        i = 0
    else:
        s_at, s_mark = np.array([state[0]]), np.array([state[1]], dtype=object)
        i = int(_next_index(at, mark, _run_ends(mark), s_at, s_mark, quiet, repeat, 0)[0])
    accepted = np.zeros(n, dtype=bool)
    while i < n:
        accepted[i] = True
        i = links[i]
    index = np.arange(n)
    anchor = np.maximum.accumulate(np.where(accepted, index, -1))
    own = anchor >= 0
    carried_at, carried_n = (state[0], state[2]) if state else (0, 0)
    anchor_at = np.where(own, at[np.maximum(anchor, 0)], carried_at)
    position = np.where(own, index - anchor + 1, carried_n + index + 1)
    return accepted, anchor_at, position


def _decide_keys(key, at, mark, quiet, repeat, states: dict):
    """The same for rows of many keys, sorted by key, time and tie: the plain loop.

    ``states`` has (at, mark, n) by key; keys without one start afresh. The state each key is left in replaces it.
    """
    accepted, anchor, position = [], [], []
    now, state, q, r = None, None, 0, 0
    for k, t, m, own_quiet, own_repeat in zip(key, at, mark, quiet, repeat):
        if not accepted or k != now:
            if accepted:
                states[now] = state
            now, state, q, r = k, states.get(k), max(own_quiet, 0), own_repeat
        age = t - state[0] if state else 0
        fresh = state is None or (age >= q and (age >= r or m != state[1] or m == ""))
        state = (t, m, 1) if fresh else (state[0], state[1], state[2] + 1)
        accepted.append(fresh)
        anchor.append(state[0])
        position.append(state[2])
    if accepted:
        states[now] = state
    return accepted, anchor, position


def _mark_keys(table: pa.Table) -> pa.Table:
    """Whole keys of a bucket marked at once; rows without a time are each accepted, with no time to measure from."""
    key = pd.factorize(table["k"].to_numpy(zero_copy_only=False), use_na_sentinel=False)[0]
    order = np.lexsort((table["tie"].to_numpy(), table["at"].to_numpy(), key))
    timed = table["at"].is_valid().to_numpy()[order]
    table, key = table.take(pa.array(order)), key[order]
    rows = table.filter(pa.array(timed))
    made = _decide_keys(key[timed].tolist(), *(rows[c].to_pylist() for c in ("at", "mark", "quiet", "repeat")), {})
    columns = []
    for values, without in zip(made, (True, None, 1)):
        column = np.full(len(timed), without, object)
        column[timed] = values
        columns.append(pa.array(column, pa.bool_() if without is True else pa.int64()))
    return pa.table([table["row"].cast(_nullable(table["row"].type)), *columns], names=["row", "accepted", "anchor_at", "position"])


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as the declared schema has it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, _nullable(kind.item_type))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return kind


def _mark_table(table: pa.Table, state: tuple | None) -> pa.Table:
    """The same on Arrow data; the input row passes through untouched."""
    order = np.lexsort((table["tie"].to_numpy(), table["at"].to_numpy()))
    table = table.take(pa.array(order))
    quiet, repeat = table["quiet"][0].as_py(), table["repeat"][0].as_py()
    mark = table["mark"].to_numpy(zero_copy_only=False)
    made = _decide(table["at"].to_numpy(), mark, quiet, repeat, state)
    row = table["row"].cast(_nullable(table["row"].type))
    return pa.table([row, *map(pa.array, made)], names=["row", "accepted", "anchor_at", "position"])


def _mark_alone(table: pa.Table) -> pa.Table:
    return _mark_table(table, None)


def _mark_with_carry(table: pa.Table, carry: pa.Table) -> pa.Table:
    if not table.num_rows:
        raise ValueError("a state arrived for a chunk without rows")
    return _mark_table(table, _state(carry.to_pandas()))


def _zone_exit(table: pa.Table, state: pa.Table) -> pa.Table:
    """What a zone leaves of the state that enters it: (k, chunk, at, mark, n), n the rows from the anchor to its end."""
    if not table.num_rows:
        return pa.Table.from_pylist([], _EXIT_ARROW)
    order = np.lexsort((table["tie"].to_numpy(), table["at"].to_numpy()))
    at = table["at"].to_numpy()[order]
    mark = table["mark"].to_numpy(zero_copy_only=False)[order]
    held = (state["at"][0].as_py(), state["mark"][0].as_py(), 0) if state.num_rows and state["at"][0].as_py() is not None else None
    accepted, anchor, position = _decide(at, mark, table["quiet"][0].as_py(), table["repeat"][0].as_py(), held)
    own = np.flatnonzero(accepted)
    row = {"k": table["k"][0].as_py(), "chunk": table["chunk"][0].as_py(), "at": None, "mark": None, "n": None}
    if len(own):
        row |= {"at": int(anchor[-1]), "mark": mark[own[-1]], "n": int(position[-1])}
    return pa.Table.from_pylist([row], _EXIT_ARROW)


_EXIT = "k string, chunk int, at long, mark string, n long"
_EXIT_ARROW = pa.schema([("k", pa.string()), ("chunk", pa.int32()), ("at", pa.int64()), ("mark", pa.string()), ("n", pa.int64())])


def _zones(base: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows in zones (``chunk``, ascending in a key's order), and the state that enters each zone as ``_CARRY``.

    Rows, zone map and each round's exits are written to the shared folder: a round reads only the files
    of the zones it looks at, and a lost executor repeats no earlier round.
    """
    spark, path = base.sparkSession, workspace(base.sparkSession, "zones")
    parts = base.count() // chunk_rows + 1
    # Rows of equal time and tie are told apart by their content, so they do not make one zone.
    cut = base.withColumn("_h", F.xxhash64(F.to_json("row"))).repartitionByRange(parts, "k", "at", "tie", "_h").drop("_h")
    cut.withColumn("chunk", F.spark_partition_id()).write.parquet(f"{path}/rows")
    rows = spark.read.schema(T.StructType([*cut.schema.fields, T.StructField("chunk", T.IntegerType())])).parquet(f"{path}/rows")
    made = rows.groupBy("k", "chunk").agg(
        F.max("at").alias("last"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("rows"),
        F.first("quiet").alias("quiet"), F.first("repeat").alias("repeat"),
    )
    made.write.parquet(f"{path}/zones")
    zones = spark.read.schema(made.schema).parquet(f"{path}/zones")
    state, told = spark.createDataFrame([], _EXIT), 0
    while True:
        # A zone can accept a row once it reaches past the quiet span, with another mark or past the repeat span.
        other = (F.col("s.mark") == "") | (F.col("low") != F.col("s.mark")) | (F.col("high") != F.col("s.mark"))
        can = (F.col("last") >= F.col("s.at") + F.greatest("quiet", F.lit(0))) & (
            (F.col("repeat") <= F.col("quiet")) | other | (F.col("last") >= F.col("s.at") + F.col("repeat"))
        )
        ahead = zones.alias("z").join(state.alias("s"), F.col("z.k").eqNullSafe(F.col("s.k")), "left").where(
            F.col("s.chunk").isNull() | ((F.col("z.chunk") > F.col("s.chunk")) & (F.col("s.at").isNull() | can))
        )
        chosen = ahead.groupBy("z.k").agg(F.min("z.chunk").alias("c"), F.first("s.at").alias("at"), F.first("s.mark").alias("mark"))
        # One row a key; a key with a hot period has chunk_rows rows at least.
        chosen.select("k", F.col("c").alias("chunk"), "at", "mark").write.parquet(f"{path}/asked/round={told}")
        asked = spark.read.schema("k string, chunk int, at long, mark string").parquet(f"{path}/asked/round={told}")
        numbers = [r[0] for r in asked.select("chunk").distinct().collect()]
        if not numbers:
            break
        looked = rows.where(F.col("chunk").isin(numbers)).drop("row").withColumn("key", F.coalesce("k", F.lit("\0")))
        entering = asked.withColumn("key", F.coalesce("k", F.lit("\0")))
        exits = looked.join(entering.select("key", "chunk"), ["key", "chunk"], "left_semi").groupBy("key", "chunk").cogroup(
            entering.groupBy("key", "chunk")
        ).applyInArrow(_zone_exit, _EXIT)
        exits.write.parquet(f"{path}/exits/round={told}")
        fresh = spark.read.schema(_EXIT).parquet(f"{path}/exits/round={told}")
        # A zone that accepted none passes the state on.
        same = F.col("f.k").eqNullSafe(F.col("a.k"))
        passed = fresh.alias("f").join(asked.alias("a"), same).select(
            "f.k", "f.chunk", F.coalesce("f.at", "a.at").alias("at"), F.coalesce("f.mark", "a.mark").alias("mark"), "f.n"
        )
        # Keys with no zone ahead keep their state.
        done = state.alias("s").join(asked.alias("a"), F.col("s.k").eqNullSafe(F.col("a.k")), "left_anti")
        state = passed.unionByName(done)
        state.write.parquet(f"{path}/states/round={told}")
        state = spark.read.schema(_EXIT).parquet(f"{path}/states/round={told}")
        told += 1
    left = spark.read.schema(_EXIT).parquet(f"{path}/exits").where("at IS NOT NULL").select(
        "k", "chunk", F.struct("at", "mark", "n").alias("left")
    )
    by_zone = W.partitionBy("k").orderBy("chunk")
    before = by_zone.rowsBetween(W.unboundedPreceding, -1)
    held = zones.alias("z").join(left.alias("l"), F.col("z.k").eqNullSafe(F.col("l.k")) & (F.col("z.chunk") == F.col("l.chunk")), "left")
    held = held.select("z.k", "z.chunk", "z.rows", "l.left")
    held = held.withColumn("upto", F.sum("rows").over(by_zone)).withColumn("end", F.when(F.col("left").isNotNull(), F.col("upto")))
    carry = held.select(
        "k", "chunk", F.last("left", True).over(before).alias("e"),
        (F.col("upto") - F.col("rows") - F.last("end", True).over(before)).alias("gap"),
    ).select("k", F.col("chunk").cast("long").alias("chunk"), F.col("e.at").alias("c_at"), F.col("e.mark").alias("c_mark"), (F.col("e.n") + F.col("gap")).alias("c_n"))
    return rows.withColumn("chunk", F.col("chunk").cast("long")), carry


def rule_rows(
    rows: DataFrame,
    key: Column,
    at_us: Column,
    tie: Column,
    quiet_us: Column,
    repeat_us: Column | None = None,
    mark: Column | None = None,
) -> DataFrame:
    """The columns the rule reads, next to the whole input row."""
    repeat_us = F.lit(0) if repeat_us is None else repeat_us
    mark = F.lit("") if mark is None else mark
    return rows.select(
        F.struct("*").alias("row"),
        key.cast("string").alias("k"),
        at_us.cast("long").alias("at"),
        tie.cast("long").alias("tie"),
        F.coalesce(quiet_us.cast("long"), F.lit(0)).alias("quiet"),
        F.coalesce(repeat_us.cast("long"), F.lit(0)).alias("repeat"),
        F.coalesce(mark, F.lit("")).alias("mark"),
    )


def _in_buckets(base: DataFrame, buckets: int, marked: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("bucket")
    return base.groupBy(bucket).applyInArrow(_mark_keys, marked)


def _in_chunks(base: DataFrame, marked: str, chunk_rows: int, fan_in: int, periods: int | None) -> DataFrame:
    # A rule without any period accepts every row; an hour keeps its chunks sane.
    span = F.greatest("quiet", "repeat")
    period = F.when(span > 0, span).otherwise(F.lit(3_600_000_000))
    loads = base.groupBy("k", period.alias("period"), F.floor(F.col("at") / period).alias("slot")).count()
    load = loads.agg(F.max("count").alias("peak"), F.min("slot").alias("low"), F.max("slot").alias("high")).first()
    peak, low, high = load["peak"] or 1, load["low"] or 0, load["high"] or 0
    if peak > chunk_rows and periods is None:
        # A row a key, and each such key has over chunk_rows rows.
        hot = loads.where(F.col("count") > chunk_rows).select(F.col("k").alias("_hot")).distinct()
        meets = F.col("k").eqNullSafe(F.col("_hot"))
        zoned, carry = _zones(base.join(hot, meets, "left_semi"), chunk_rows)
        there = zoned.groupBy("k", "chunk").cogroup(carry.groupBy("k", "chunk")).applyInArrow(_mark_with_carry, marked)
        return there.unionByName(_in_chunks(base.join(hot, meets, "left_anti"), marked, chunk_rows, fan_in, None))
    if periods is None:
        periods = int(min(max(chunk_rows // peak, 1), MAX_PERIODS))

    width = period * F.lit(periods)
    chunked = base.withColumn("chunk", F.floor(F.col("at") / width)).withColumn("start", F.col("chunk") * width)
    if low // periods == high // periods:
        return chunked.groupBy("k", "chunk").applyInArrow(_mark_alone, marked)

    slim = chunked.drop("row")
    levels = [slim.groupBy("k", "chunk").applyInPandas(lambda pdf: _chunk_table(pdf), _TABLE)]
    n_chunks = high // periods - low // periods + 1
    while n_chunks > fan_in:
        parent = F.floor(F.col("chunk") / F.lit(fan_in)).alias("parent")
        levels.append(levels[-1].groupBy("k", parent).applyInPandas(_merged_table, _TABLE))
        n_chunks = n_chunks // fan_in + 1
    carry = levels.pop().groupBy("k").applyInPandas(_top_walk, _CARRY)
    while levels:
        below = levels.pop().withColumn("parent", F.floor(F.col("chunk") / F.lit(fan_in)))
        above = carry.withColumnRenamed("chunk", "parent")
        carry = (
            below.groupBy("k", "parent").cogroup(above.groupBy("k", "parent")).applyInPandas(_down_walk, _CARRY)
        )
    return chunked.groupBy("k", "chunk").cogroup(carry.groupBy("k", "chunk")).applyInArrow(_mark_with_carry, marked)


def apply_quiet_rule(
    rows: DataFrame,
    key: Column,
    at_us: Column,
    tie: Column,
    quiet_us: Column,
    repeat_us: Column | None = None,
    mark: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
    periods: int | None = None,
) -> DataFrame:
    """Add ``accepted``, ``anchor_at`` and ``position`` to every row.

    ``anchor_at`` is the time of the last accepted row up to and including this
    one, ``position`` counts the rows since it (the accepted row is 1). Rows
    that share a time are ordered by ``tie``. ``quiet_us`` and ``repeat_us``
    must be constant within a key.
    """
    base = rule_rows(rows, key, at_us, tie, quiet_us, repeat_us, mark)
    marked = f"row {base.schema['row'].dataType.simpleString()}, accepted boolean, anchor_at long, position long"
    out = F.col("row.*"), F.col("accepted"), F.col("anchor_at"), F.col("position")
    if periods is not None:
        return _in_chunks(base, marked, chunk_rows, fan_in, periods).select(*out)
    held = base.groupBy("k").count()
    load = held.agg(F.sum("count").alias("rows"), F.max("count").alias("peak")).first()
    few = max(chunk_rows // KEY_PART, 1)
    buckets = (load["rows"] or 0) // max(chunk_rows // BUCKET_PART, 1) + 1
    if (load["peak"] or 0) <= few:
        return _in_buckets(base, buckets, marked).select(*out)
    # A row a key, and each such key has over ``few`` rows.
    many = held.where(F.col("count") > few).select(F.col("k").alias("_many"))
    meets = F.col("k").eqNullSafe(F.col("_many"))
    here = _in_buckets(base.join(many, meets, "left_anti"), buckets, marked)
    there = _in_chunks(base.join(many, meets, "left_semi"), marked, chunk_rows, fan_in, None)
    return there.unionByName(here).select(*out)


def rate_limit(
    requests: DataFrame, key: str, at: str, tie: str, limit: int, window_us: int, rule=apply_quiet_rule, **tuning
) -> DataFrame:
    """Fixed window opened by a key's first request; blocked requests do not count."""
    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    ruled = rule(requests, F.col(key), at_us, F.col(tie), F.lit(window_us), **tuning)
    return (
        ruled.withColumn("allowed", F.col("position") <= limit)
        .withColumn("remaining", F.greatest(F.lit(limit) - F.col("position"), F.lit(0)))
        .drop("accepted", "position")
    )


def suppress_alerts(triggered: DataFrame, rule=apply_quiet_rule, **tuning) -> DataFrame:
    """Cool-down first, then de-duplication, against the last alert sent.

    Needs monitor_id, evaluation_id, evaluated_at, cooldown_minutes,
    dedupe_minutes and dedupe_key; adds delivery_state and last_sent_us.
    """
    quiet = minutes_us(F.greatest("cooldown_minutes", F.lit(0)))
    at_us = F.unix_micros(F.col("evaluated_at").cast("timestamp"))
    ruled = rule(
        triggered,
        F.col("monitor_id"),
        at_us,
        F.col("evaluation_id"),
        quiet,
        minutes_us(F.greatest("dedupe_minutes", F.lit(0))),
        F.btrim("dedupe_key"),
        **tuning,
    )
    cooling = at_us - F.col("anchor_at") < quiet
    state = F.when(F.col("accepted"), "sent").when(cooling, "cooldown").otherwise("deduped")
    return (
        ruled.withColumn("delivery_state", state)
        .withColumnRenamed("anchor_at", "last_sent_us")
        .drop("accepted", "position")
    )


def new_nonces(
    requests: DataFrame, nonce: str, received_us: str, tie: str, ttl_us: int, rule=apply_quiet_rule, **tuning
) -> DataFrame:
    """A nonce is fresh once, and again only after its entry expired.

    The entry ends strictly after received time plus ttl; replays do not extend it.
    """
    ruled = rule(
        requests, F.col(nonce), F.col(received_us), F.col(tie), F.lit(ttl_us + 1), **tuning
    )
    return ruled.withColumnRenamed("accepted", "fresh").drop("anchor_at", "position")
