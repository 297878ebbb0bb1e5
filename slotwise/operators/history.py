"""Event history, validation and access filters over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_base58, is_identifier, strip
from ..functions.timing import minutes_us, parse_rfc3339
from ..session import dimension

HISTORY_COLUMNS = ("timestamp", "program_id", "event_type", "signature", "payload")


def page_bounds(limit: int, offset: int, cap: int) -> tuple[int, int]:
    """Non-positive limits mean 100, larger ones the cap; offsets start at 0."""
    return min(limit if limit > 0 else 100, cap), max(offset, 0)


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, cap: int = 500) -> DataFrame:
    limit, offset = page_bounds(limit, offset, cap)
    return df.orderBy(*order).offset(offset).limit(limit)


def utc_bound(text: str) -> Column:
    """RFC 3339 text as a plain UTC timestamp literal the scan can push down."""
    from datetime import datetime, timezone

    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{text!r} must be an RFC 3339 timestamp")
    plain = at.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(plain.isoformat(sep=" ")).cast("timestamp_ntz")


def event_history(
    events: DataFrame,
    program_id: str,
    event_type: str = "",
    start: str = "",
    end: str = "",
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Newest events of one program, both time bounds inclusive."""
    kept = events.where(F.col("program_id") == program_id.strip())
    if event_type.strip():
        kept = kept.where(F.col("event_type") == event_type.strip())
    if start.strip():
        kept = kept.where(F.col("timestamp") >= utc_bound(start))
    if end.strip():
        kept = kept.where(F.col("timestamp") <= utc_bound(end))
    newest = [F.col("timestamp").desc(), F.col("event_id").desc()]
    return page(kept, newest, limit, offset, cap=1000).select(*HISTORY_COLUMNS)


def half_open(events: DataFrame, start: str, end: str, at: str = "timestamp") -> DataFrame:
    return events.where((F.col(at) >= utc_bound(start)) & (F.col(at) < utc_bound(end)))


def count_last_day(events: DataFrame, as_of: str) -> DataFrame:
    since = utc_bound(as_of) - F.expr("INTERVAL 1 DAY")
    return events.where(F.col("timestamp") >= since).agg(F.count("*").alias("events"))


def with_program_check(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("is_valid", is_base58(F.col(column)))


def with_identifier_check(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("is_valid", is_identifier(F.col(column)))


def normalized_grants(grants: DataFrame) -> DataFrame:
    """Roles other than admin mean read; no programs at all means every program."""
    admin = F.lower(strip(F.col("role"))) == "admin"
    programs = F.filter(F.transform("programs", strip), lambda p: p != "")
    everything = F.array(F.lit("*"))
    return grants.select(
        "subject",
        F.when(admin, "admin").otherwise("read").alias("role"),
        F.when(F.size(programs) == 0, everything).otherwise(F.array_distinct(programs)).alias("programs"),
    )


def visible_rows(df: DataFrame, grant_role: str, grant_programs: list[str], column: str = "program_id") -> DataFrame:
    """Rows one subject may see; rows without a program are public."""
    if grant_role == "admin" or "*" in grant_programs:
        return df
    program = strip(F.coalesce(F.col(column), F.lit("")))
    return df.where((program == "") | program.isin(list(grant_programs)))


def program_access(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """(subject, program_id) pairs for which the subject may see the program's rows.

    Rows are reduced to their programs first and a reader joins or filters with the pairs, so
    no subject multiplies the table. Grants are one key per program; whole-table grants
    use the key '*', which every program also offers.
    """
    keys = normalized_grants(grants).select(
        "subject",
        F.explode(
            F.when((F.col("role") == "admin") | F.array_contains("programs", "*"), F.array(F.lit("*")))
            .otherwise(F.array_append("programs", F.lit("")))
        ).alias("access_key"),
    )
    program = strip(F.coalesce(F.col("program_id"), F.lit("")))
    programs = rows.select("program_id", program.alias("_program")).distinct()
    offered = programs.select("program_id", F.explode(F.array("_program", F.lit("*"))).alias("access_key"))
    return offered.join(dimension(keys), "access_key").select("subject", "program_id").distinct()


def due_monitors(monitors: DataFrame, last_evaluated: DataFrame, now: str) -> DataFrame:
    """Active monitors never evaluated, or last evaluated a schedule ago."""
    wait = F.when(F.col("schedule_minutes") > 0, F.col("schedule_minutes")).otherwise(F.lit(60))
    age = F.unix_micros(utc_bound(now).cast("timestamp")) - F.unix_micros(
        F.col("last_evaluated_at").cast("timestamp")
    )
    due = F.col("last_evaluated_at").isNull() | (age >= minutes_us(wait))
    return monitors.where("is_active").join(last_evaluated, "monitor_id", "left").where(due)


def point_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def valid_launches(requests: DataFrame) -> DataFrame:
    """Trimmed launches with their first complaint, NULL when accepted."""
    program = strip(F.col("program_id"))
    name = strip(F.col("name"))
    at = parse_rfc3339(F.col("launch_at"))
    return requests.select(
        "launch_idx",
        F.when(name == "", program).otherwise(name).alias("name"),
        program.alias("program_id"),
        at.cast("timestamp_ntz").alias("launch_ts"),
        F.when(program == "", "each launch requires program_id")
        .when(~is_base58(program), "program_id must be base58")
        .when(at.isNull(), "launch_at must be RFC3339 timestamp")
        .alias("reject_reason"),
    )
