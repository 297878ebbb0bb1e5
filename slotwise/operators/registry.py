"""Snapshots of small mutable tables: program registry and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import utc_bound
from ..functions.text import blank_to_null, is_base58, is_http_url, is_identifier, is_json, strip


def validate_routes(requests: DataFrame) -> DataFrame:
    """Trimmed route requests with their first complaint, NULL when accepted."""
    url, program, kind = (strip(F.col(c)) for c in ("url", "program_id", "event_type"))
    reason = (
        F.when(F.coalesce(url, F.lit("")) == "", "url is required")
        .when(~is_http_url(url), "url is invalid")
        .when((program != "") & ~is_base58(program), "program_id must be base58")
        .when((kind != "") & ~is_identifier(kind), "event_type contains unsupported characters")
    )
    return requests.select(
        "route_id", url.alias("url"), program.alias("program_id"), kind.alias("event_type"),
        reason.alias("reject_reason"),
    )


def merge_registry(registry: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Apply one change per program: create, update or delete. Several changes of one
    program have no order among them: their result is ``conflict`` and the base row stays.
    Created and updated rows carry ``now`` as updated_at.

    Gives every program with its merged row and ``result``; rows whose result is
    ``deleted``, ``missing`` or ``invalid`` with no base row are not part of the
    next snapshot (see :func:`snapshot`).
    """
    asked = changes.select(
        strip(F.col("program_id")).alias("program_id"),
        F.col("action"),
        blank_to_null(F.col("name")).alias("_name"),
        F.nullif(F.col("content"), F.lit("")).alias("_content"),
    ).groupBy("program_id").agg(
        *(F.any_value(c).alias(c) for c in ("action", "_name", "_content")), F.count("*").alias("_asked")
    )
    merged = registry.withColumn("_known", F.lit(True)).join(asked, "program_id", "full_outer")
    known, content = F.col("_known").isNotNull(), F.col("_content")
    creates, updates, deletes = (F.col("action") == a for a in ("create", "update", "delete"))
    broken = content.isNotNull() & ~is_json(content)
    result = (
        F.when(F.col("_asked").isNull(), "unchanged")
        .when(F.col("_asked") > 1, "conflict")
        .when(F.col("program_id") == "", "invalid")
        .when(creates & (content.isNull() | broken), "invalid")
        .when(creates & known, "duplicate")
        .when(creates, "created")
        .when(updates & (broken | (content.isNull() & F.col("_name").isNull())), "invalid")
        .when(updates & ~known, "missing")
        .when(updates, "updated")
        .when(deletes & known, "deleted")
        .otherwise("missing")
    )
    takes = F.col("result").isin("created", "updated")
    return merged.withColumn("result", result).select(
        "program_id",
        F.when(takes, F.coalesce("_name", "name", F.lit(""))).otherwise(F.col("name")).alias("name"),
        F.when(takes, F.coalesce("_content", "content")).otherwise(F.col("content")).alias("content"),
        "result",
        known.alias("was_known"),
        F.when(takes, utc_bound(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def snapshot(merged: DataFrame) -> DataFrame:
    """Rows of the next registry version."""
    stays = (F.col("was_known") | (F.col("result") == "created")) & (F.col("result") != "deleted")
    return merged.where(stays).select("program_id", "name", "content", "updated_at")
