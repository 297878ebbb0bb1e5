"""Monitors' own query texts, one plan for each distinct text.

A text's place holders stand inside quoted literals. They become columns of a table of parameters
(one row for each program and window that monitors with this text have), and the text runs as a
correlated LATERAL subquery beside that table: the engine joins the events with all
parameters at once. Thousands of monitors with few texts cost a few plans.

A text over other tables or functions than allowed, one that cannot be resolved and one that breaks
while it runs fail their own monitors only. Each text's values are written before they are
joined, so such a failure cannot reach the others.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import rfc3339
from ..session import workspace
from .guard import _numeric_fields, guard_texts, over_tables, plan_reason
from .history import utc_bound

_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"", re.S)
_HOLDER = re.compile(r"\{\{(program_id|from|to)\}\}")
#: Comparisons that stand alone between AND, OR, NOT, WHERE or brackets.
_ALONE = r"(?i)(\b(?:where|and|or|not|on)\s+|\(\s*)"
_SINCE = re.compile(_ALONE + r"([a-z_][\w.]*)\s*(>=?)\s*'\{\{from\}\}'")
_OF_PROGRAM = re.compile(_ALONE + r"((?:\w+\.)?program_id)\s*=\s*'\{\{program_id\}\}'")
#: How many texts run at a time; each is a job of its own.
TEXTS_AT_ONCE = 8

# What a failed evaluation's error says.
INVALID, BROKEN, NO_VALUE = "query validation failed: ", "query execution failed: ", "failed to read metric value: no numeric value"


def bound_template(text: str, earliest: str, to: str) -> tuple[str, dict[str, list[str]]]:
    """The text with its quoted place holders as columns of ``_params``, and the pieces of columns that mix
    place holders with other text; ValueError if a place holder stands outside quotes.

    ``{{to}}`` is one instant for all monitors and stays a literal. A comparison with ``{{from}}`` also gets
    the earliest start of all monitors as a literal, which changes no result and bounds the scan. An
    equality with the program compares an expression of the column: of the bare column the engine would take
    the program out of the parameters it joins by, and meet every event with every window of any program.
    """
    text = _SINCE.sub(lambda m: f"{m[1]}({m[2]} {m[3]} '{earliest}' AND {m[2]} {m[3]} '{{{{from}}}}')", text)
    text = _OF_PROGRAM.sub(lambda m: f"{m[1]}concat({m[2]}, '') = '{{{{program_id}}}}'", text)
    mixed: dict[str, list[str]] = {}

    def literal(m: re.Match) -> str:
        quote, body = m[0][0], m[0][1:-1].replace("{{to}}", to)
        pieces = _HOLDER.split(body)  # every other piece is a name
        if len(pieces) == 1:
            return f"{quote}{body}{quote}"
        if len(pieces) == 3 and not pieces[0] and not pieces[2]:
            return f"_params._{pieces[1]}"
        name = f"_mixed{len(mixed)}"
        mixed[name] = [f"_{p}" if i % 2 else f"{quote}{p}{quote}" for i, p in enumerate(pieces)]
        return f"_params.{name}"

    out, done = [], 0
    for m in _LITERAL.finditer(text):
        out += [text[done:m.start()], literal(m)]
        if _HOLDER.search(text[done:m.start()]):
            raise ValueError("a place holder stands outside quotes")
        done = m.end()
    if _HOLDER.search(text[done:]):
        raise ValueError("a place holder stands outside quotes")
    return "".join([*out, text[done:]]), mixed


def text_values(spark: SparkSession, text: str, params: DataFrame, tables: dict[str, DataFrame], earliest: str, to: str) -> DataFrame:
    """(program_id, window_minutes, value) of one text for all its parameters, value null where it gives no number.

    The value is the first numeric field of the first row, as for a single query with one row.
    """
    bound, mixed = bound_template(text, earliest, to)
    reason = plan_reason(spark, bound, tables)
    if reason:
        raise ValueError(reason)
    params = params.selectExpr("*", *(f"concat({', '.join(pieces)}) AS {name}" for name, pieces in mixed.items()))
    made = over_tables(
        spark, f"SELECT _params.*, _found.* FROM _params LEFT JOIN LATERAL (SELECT * FROM ({bound}) LIMIT 1) AS _found",
        tables | {"_params": params},
    )
    n = len(params.columns)
    names = [*params.columns, *(f"_c{i}" for i in range(len(made.columns) - n))]
    made = made.toDF(*names).select("*", F.struct(*names[n:]).alias("_row"))
    lead = F.get(_numeric_fields(made, F.col("_row"), names[n:]), F.lit(0))["value"]
    return made.select(F.col("_program_id").alias("program_id"), F.col("_window").cast("int").alias("window_minutes"), lead.alias("value"))


def template_values(monitors: DataFrame, now: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Monitors with ``value`` (null if the evaluation failed) and ``error`` (why; empty if it did not).

    The distinct texts come to the driver, as plans do; monitors, parameters and values stay tables.
    """
    spark = monitors.sparkSession
    end = utc_bound(now)
    start = rfc3339(end - F.make_dt_interval(mins=F.col("window_minutes")))
    rendered = monitors.withColumn("_start", start).withColumn(
        "_text", F.replace("query_template", F.lit("{{program_id}}"), F.replace("program_id", F.lit("'"), F.lit("''")))
    )
    # The guard reads what would be sent, program included; the texts that run are the cleaned templates.
    checked = guard_texts(rendered, "_text").withColumnRenamed("reject_reason", "_unsafe").drop("clean_sql", "_text")
    checked = guard_texts(checked, "query_template").drop("reject_reason").withColumnRenamed("clean_sql", "_text")
    out = workspace(spark, "template-values")
    # Written once: each text's plan reads its parameters several times.
    checked.write.parquet(f"{out}-monitors")
    checked = spark.read.schema(checked.schema).parquet(f"{out}-monitors")
    safe = checked.where("_unsafe IS NULL")
    texts = safe.groupBy("_text").agg(F.min("_start").alias("earliest")).collect()
    to = spark.range(1).select(rfc3339(end)).first()[0]

    def run(place: int) -> tuple[str, int, str]:
        text, path = texts[place]["_text"], f"{out}/text={place}"
        params = safe.where(F.col("_text") == text).select(
            F.col("program_id").alias("_program_id"), F.col("window_minutes").alias("_window"), F.col("_start").alias("_from")
        ).distinct()
        try:
            text_values(spark, text, params, tables, texts[place]["earliest"], to).write.parquet(path)
            return text, place, ""
        except (PySparkException, ValueError) as failure:
            return text, place, BROKEN + str(failure).splitlines()[0]

    with ThreadPoolExecutor(TEXTS_AT_ONCE) as pool:
        told = list(pool.map(run, range(len(texts))))
    status = spark.createDataFrame(told, "_text string, _place int, _broken string")
    schema = "program_id string, window_minutes int, value double"
    done = [f"{out}/text={place}" for _, place, error in told if not error]
    values = spark.read.schema(f"{schema}, text int").option("basePath", out).parquet(*done) if done else spark.createDataFrame([], f"{schema}, text int")
    values = values.withColumnRenamed("text", "_place")
    # As many rows as there are distinct texts.
    joined = checked.join(F.broadcast(status), "_text", "left").join(values, ["_place", "program_id", "window_minutes"], "left")
    error = (
        F.when(F.col("_unsafe").isNotNull(), F.concat(F.lit(INVALID), "_unsafe"))
        .when(F.col("_broken") != "", F.col("_broken"))
        .when(F.col("value").isNull(), F.lit(NO_VALUE))
        .otherwise(F.lit(""))
    )
    return joined.select(*monitors.columns, "value", error.alias("error"))


def recognised(template: Column) -> Column:
    """Which shared count a text asks for, NULL for any other text.

    Only the plain form counts: one count over ``chain_events`` for the monitor's program and window.
    """
    def shape(count: str) -> str:
        where = r"WHERE program_id = (?-i:'\{\{program_id\}\}') AND timestamp >= (?-i:'\{\{from\}\}') AND timestamp < (?-i:'\{\{to\}\}')"
        return rf"(?i)^\s*SELECT {count}(?: AS [a-z_]+)? FROM chain_events {where}\s*$".replace(" ", r"\s+")

    return (
        F.when(template.rlike(shape(r"count\(\*\)")), "events")
        .when(template.rlike(shape(r"count_if\(event_type = (?-i:'transaction')\)")), "transactions")
        .when(template.rlike(shape(r"count\(DISTINCT signature\)")), "signers")
    )
