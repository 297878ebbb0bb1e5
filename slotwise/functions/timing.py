"""Time parsing and formatting as column expressions (UTC throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(c: Column) -> Column:
    """Instant of an RFC 3339 text, else NULL. A bare date does not count."""
    text = strip(c)
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def parse_unix_or_rfc3339(c: Column) -> Column:
    text = strip(c)
    seconds = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.coalesce(F.timestamp_seconds(seconds), parse_rfc3339(text))


def rfc3339(c: Column) -> Column:
    """UTC text to the second; fractions are dropped."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_second(c: Column) -> Column:
    return F.date_trunc("second", c).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def minutes_or(c: Column, fallback: int) -> Column:
    """Non-positive or missing settings take the fallback."""
    return F.when(c > 0, c).otherwise(F.lit(fallback))


def minutes_us(c: Column) -> Column:
    return c.cast("bigint") * F.lit(60_000_000)
