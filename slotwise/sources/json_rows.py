"""JSON lines: query results and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import strip

_KEEP_NULLS = {"ignoreNullFields": "false"}
# The default format keeps milliseconds only.
_MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, one bad line fails the read."""
    return spark.read.schema(schema).options(mode="FAILFAST", **_MICROS).json(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(**_KEEP_NULLS, **_MICROS).json(path)


def dead_letter_rows(events: DataFrame, failed_at_ms, error) -> DataFrame:
    return events.select(
        failed_at_ms.cast("bigint").alias("failed_at_unix_ms"),
        error.alias("error"),
        F.struct(*[f.name for f in schemas.NORMALIZED_EVENT.fields]).alias("event"),
    )


def append_dead_letters(letters: DataFrame, path: str) -> None:
    letters.select(F.to_json(F.struct(*letters.columns), _KEEP_NULLS).alias("value")).write.mode("append").text(path)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Parsed letters; unparsable lines stay as raw text with a NULL record."""
    return parse_dead_letters(spark.read.text(path).where(strip(F.col("value")) != ""))


def parse_dead_letters(lines: DataFrame) -> DataFrame:
    parsed = F.from_json(strip(F.col("value")), schemas.DEAD_LETTER, {"mode": "PERMISSIVE"})
    whole = parsed["event"]["event_id"].isNotNull() & parsed["failed_at_unix_ms"].isNotNull()
    return lines.select(
        strip(F.col("value")).alias("raw"), F.when(whole, parsed).alias("letter")
    ).select("raw", "letter.*")
