"""Session helpers shared by batch and streaming jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a dimension may hold to be broadcast: rows, and bytes of its rows as text.
BROADCAST_ROW_LIMIT = 500_000
BROADCAST_BYTE_LIMIT = 128 << 20


def local_session(cpus: int | str = 8, name: str = "slotwise") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC; instants and plain timestamps then agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared storage that ``spark.checkpoint.dir`` names.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="slotwise-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def fits_broadcast(dim: DataFrame, limit: int | None = None, byte_limit: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Measure the dimension, stopping just past the row limit."""
    limit = BROADCAST_ROW_LIMIT if limit is None else limit
    if not limit:
        return False
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    held = dim.limit(limit + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return held["rows"] <= limit and held["bytes"] <= byte_limit


def dimension(dim: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a dimension for broadcast when its counted size allows it.

    Past the limit the plain DataFrame goes back, so the join shuffles on its
    key and adaptive execution splits the skewed partitions.
    """
    return F.broadcast(dim) if fits_broadcast(dim, limit) else dim.hint("merge")
