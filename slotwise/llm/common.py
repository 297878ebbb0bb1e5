"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where SQL can express it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a local session, as in tests, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="slotwise-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps neither repeat
    nor depend on the executors that made it."""
    path = folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession, times: int = 1) -> int:
    """Partitions of an exchange, following the session's setting for its data size."""
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def cells(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def in_pieces(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield record(schema, dict(zip(schema.names, zip(*held))))
            held = []
    if held:
        yield record(schema, dict(zip(schema.names, zip(*held))))


def sized_pieces(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Row tuples, texts as UTF-8 bytes, as record batches of bounded length and bytes; a longer row goes alone."""
    held: list[tuple] = []
    size = 0

    def batch():
        columns = []
        for f, column in zip(schema, zip(*held)):
            if pa.types.is_string(f.type):
                columns.append(pa.array(column, pa.binary()).cast(pa.string()) if any(isinstance(x, bytes) for x in column) else pa.array(column, f.type))
            else:
                columns.append(pa.array(column, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        length = sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if held and (len(held) == most or size + length > most_bytes):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += length
    if held:
        yield batch()
