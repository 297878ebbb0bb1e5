"""Read-only guard for SQL texts, guarded execution, evidence and reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.scoring import (
    report_confidence,
    report_verdict,
    suggested_comparator,
    suggested_threshold,
)
from ..functions.signing import sql_hash
from ..functions.text import blank_to_null, strip, to_double
from .history import normalized_grants

# Words that make a text unsafe.
FORBIDDEN = (
    "insert", "update", "delete", "drop", "alter", "truncate", "optimize", "system",
    "create", "attach", "detach", "grant", "revoke", "kill", "rename",
)
# Row caps of guarded queries and their evidence.
DEFAULT_ROWS, MAX_ROWS, MAX_VALUES, SAMPLE_ROWS = 100, 1000, 100, 20

# ASCII word edges; Java's \b also counts accented letters as word characters.
_EDGE_BEFORE, _EDGE_AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


_FORMAT_CLAUSE = r"(?i)[\t\n\f\r ]+format[\t\n\f\r ]+[a-z_0-9]+[\t\n\f\r ]*\z"


def clean_sql(text: Column) -> Column:
    """Trim, one trailing ';', code fences and a trailing FORMAT clause removed."""
    c = strip(text)
    for edge in (r";\z", r"^```sql", r"^```", r"```\z", _FORMAT_CLAUSE):
        c = strip(F.regexp_replace(c, edge, ""))
    return c


def reject_reason(cleaned: Column) -> Column:
    """First broken rule, NULL for an acceptable text."""
    low = F.lower(cleaned)
    unsafe = rf"(?iu){_EDGE_BEFORE}(?:{'|'.join(FORBIDDEN)}){_EDGE_AFTER}"
    return (
        F.when(F.coalesce(cleaned, F.lit("")) == "", "sql query is empty")
        .when(
            cleaned.contains("--") | cleaned.contains("/*") | cleaned.contains("*/"),
            "sql comments are not allowed",
        )
        .when(cleaned.contains(";"), "multiple statements are not allowed")
        .when(
            ~(low.startswith("select") | low.startswith("with")), "only read-only SELECT queries are allowed"
        )
        .when(cleaned.rlike(unsafe), "query contains unsupported keywords")
    )


def guard_texts(texts: DataFrame, column: str) -> DataFrame:
    """Add clean_sql and reject_reason to a table of query texts."""
    cleaned = texts.withColumn("clean_sql", clean_sql(F.col(column)))
    return cleaned.withColumn("reject_reason", reject_reason(F.col("clean_sql")))


def references_table(text: Column, table: str) -> Column:
    """Whole-word mention of the table, any case; a blank table is always met."""
    name = table.strip().lower()
    if not name:
        return F.lit(True)
    # An edge only exists where a word and a non-word character meet.
    before = r"(?<![0-9a-z_])" if re.match(r"[0-9a-z_]", name[0]) else r"(?<=[0-9a-z_])"
    after = r"(?![0-9a-z_])" if re.match(r"[0-9a-z_]", name[-1]) else r"(?=[0-9a-z_])"
    return F.lower(text).rlike(before + re.sub(r"([^0-9a-z_])", r"\\\1", name) + after)


def guard_one(spark: SparkSession, text: str) -> str:
    """The cleaned text, or ValueError with the reason."""
    row = guard_texts(spark.createDataFrame([(text,)], "q string"), "q").first()
    if row["reject_reason"]:
        raise ValueError(row["reject_reason"])
    return row["clean_sql"]


#: Groups of Spark's functions a text may call. None of them reads files, runs code by name or
#: tells about the session (those are in the groups for miscellaneous, XML, CSV and table functions).
FUNCTION_GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "url_funcs", "window_funcs",
)
#: Nodes of a parsed plan that a text may have besides expressions.
PLAN_NODES = (
    "UnresolvedWith", "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "SubqueryAlias",
    "Distinct", "Union", "Intersect", "Except", "Generate", "LocalRelation", "OneRowRelation", "UnresolvedHaving", "WithWindowDefinition",
    "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "Pivot", "Unpivot", "Expand",
)
_EXPRESSIONS = (
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedFunction", "UnresolvedExtractValue", "UnresolvedGenerator",
    "UnresolvedDeserializer", "MultiAlias", "UnresolvedOrdinal", "UnresolvedStarExceptOrReplace", "UnresolvedStarWithColumns",
)


def _plan_nodes(found):
    if isinstance(found, dict):
        if "class" in found:
            yield found
        for value in found.values():
            yield from _plan_nodes(value)
    elif isinstance(found, list):
        for value in found:
            yield from _plan_nodes(value)


def _names(text: str) -> list[str]:
    return [n.strip() for n in text.strip("[]").split(",")]


def plan_reason(spark: SparkSession, sql: str, tables: Iterable[str]) -> str | None:
    """Why a text may not run over the named tables, by walking Spark's parsed plan; None if it may.

    Only SELECT-like nodes are let through, only the named tables and the text's own common table
    expressions, and only functions of FUNCTION_GROUPS. Names of more than one part (catalogs, files)
    are never tables. A common table expression may not take the name of a session's table: outside its scope
    the name would mean that table.
    """
    state = spark._jsparkSession.sessionState()
    try:
        nodes = list(_plan_nodes(json.loads(state.sqlParser().parsePlan(sql).toJSON())))
    except PySparkException:
        return "query cannot be parsed"
    allowed = {t.lower() for t in tables}
    own = {r["_1"].lower() for n in nodes for r in n.get("cteRelations") or []}
    for name in sorted(own - allowed):
        if spark.catalog.tableExists(f"`{name}`"):
            return f"name is taken by a table: {name}"
    info = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for node in nodes:
        package, kind = node["class"].rsplit(".", 1)
        if kind == "UnresolvedRelation":
            name = node["multipartIdentifier"].strip("[]")
            if name.lower() not in allowed | own:
                return f"table is not allowed: {name}"
        elif kind == "UnresolvedFunction":
            parts = _names(node["nameParts"])
            known = len(parts) == 1 and state.catalog().isBuiltinFunction(info(parts[0].lower()))
            if not known or state.catalog().lookupFunctionInfo(info(parts[0].lower())).getGroup() not in FUNCTION_GROUPS:
                return f"function is not allowed: {'.'.join(parts)}"
        elif kind not in PLAN_NODES and kind not in _EXPRESSIONS and not package.endswith("catalyst.expressions") and not (
            package.endswith("catalyst.expressions.aggregate") or package.endswith("catalyst.plans") or "catalyst.expressions." in node["class"]
        ):
            return f"query part is not allowed: {kind}"
    return None


def over_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A text in which the given names mean the given frames, whatever the session calls by them.

    The names are common table expressions of this statement alone, so nothing of the session changes
    for other threads. Views of made-up names carry the frames and go once the text is resolved.
    """
    views = {name: f"_guarded_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        head = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {head} {sql}" if head else sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def run_guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A checked text over the given tables and nothing else."""
    reason = plan_reason(spark, sql, tables)
    if reason:
        raise ValueError(reason)
    return over_tables(spark, f"SELECT * FROM ({sql})", tables)


def guarded_query(
    spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int = DEFAULT_ROWS, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Run one read-only text over the given tables, capped as the API caps it."""
    sql = guard_one(spark, text)
    return run_guarded(spark, sql, tables).limit(min(limit if limit > 0 else DEFAULT_ROWS, max_rows))


def subject_tables(tables: dict[str, DataFrame], grants: DataFrame, subject: str) -> dict[str, DataFrame]:
    """The tables as one subject sees them: rows of the programs granted and rows without a program.

    A subject without a grant sees none of a table's rows. The grant is one row, read by a scalar subquery,
    so a text over these tables reads only what its filters and the grant leave.
    """
    # Rows of grants of one subject are few; their union is one row.
    own = normalized_grants(grants).where(F.col("subject") == subject).agg(
        F.max((F.col("role") == "admin") | F.array_contains("programs", "*")).alias("all"),
        F.array_distinct(F.flatten(F.collect_list("programs"))).alias("programs"),
        F.count("*").alias("n"),
    )
    out = {}
    for name, df in tables.items():
        if "program_id" not in df.columns:
            out[name] = df
            continue
        held = df.withColumn("_grant", own.select(F.struct("all", "programs", "n")).scalar())
        program = strip(F.coalesce(F.col("program_id"), F.lit("")))
        seen = F.coalesce(F.col("_grant.all"), F.lit(False)) | (
            (F.col("_grant.n") > 0) & ((program == "") | F.array_contains("_grant.programs", program))
        )
        out[name] = held.where(seen).select(df.columns)
    return out


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def _number(df: DataFrame, name: str, value: Column) -> Column | None:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_double(value)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return None


def _numeric_fields(df: DataFrame, row: Column, names: list[str]) -> Column:
    """(metric, value) of the fields of a row that hold a number, in the given order."""
    entries = [(n, _number(df, n, row[n])) for n in names]
    made = [F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in entries if v is not None]
    if not made:
        return F.array().cast("array<struct<metric:string,value:double>>")
    return F.filter(F.array(*made), lambda k: k["value"].isNotNull())


def result_kpis(df: DataFrame, order: list[Column]) -> DataFrame:
    """Numeric fields of the first row, by name."""
    first = df.orderBy(*order).limit(1).select(F.struct(*df.columns).alias("r"))
    kpis = _numeric_fields(df, F.col("r"), sorted(df.columns))
    return first.select(F.posexplode(kpis).alias("position", "kpi")).select(
        "position", "kpi.metric", "kpi.value"
    )


def first_numeric(df: DataFrame, order: list[Column]) -> DataFrame:
    """First numeric field, in column order, of the first row."""
    first = df.orderBy(*order).limit(1).select(F.struct(*df.columns).alias("r"))
    return first.select(F.get(_numeric_fields(df, F.col("r"), df.columns), F.lit(0)).alias("found")).select(
        "found.metric", "found.value"
    )


def evidence_values(df: DataFrame, order: list[str], limit: int = MAX_VALUES) -> DataFrame:
    """First-seen distinct programs, signatures and slots of a result, in one pass over it.

    Each (field, value) keeps the smallest position it was seen at, which combines before the
    only shuffle of values; each partition then gives its first ``limit`` of a field to the ranking.
    ``total`` is the number of distinct values of the field, ``truncated`` tells that not all are listed.
    """
    entries = []
    for field in ("program_id", "signature", "slot"):
        if field not in df.columns:
            continue
        kind = df.schema[field].dataType
        if field == "slot":
            number = to_double(F.col(field)) if isinstance(kind, T.StringType) else F.col(field).cast("double")
            values = F.array(F.when(number >= 0, F.floor(number).cast("bigint")).cast("string"))
        elif isinstance(kind, T.ArrayType):
            values = F.transform(field, strip)
        else:
            values = F.array(blank_to_null(F.col(field).cast("string")))
        entries.append(F.arrays_zip(F.array_repeat(F.lit(field), F.size(values)).alias("field"), values.alias("value")))
    if not entries:
        return df.sparkSession.createDataFrame([], "field string, position int, value string, total bigint, truncated boolean")
    seen = (
        df.select(F.explode(F.concat(*entries)).alias("e"), F.struct(*order).alias("place"))
        .select("e.field", "e.value", "place")
        .where("value IS NOT NULL AND value <> ''")
        .groupBy("field", "value")
        .agg(F.min("place").alias("place"))
    )
    # Three rows at most.
    totals = seen.groupBy("field").agg(F.count("*").alias("total"))
    rank = F.row_number().over(W.partitionBy("field").orderBy("place", "value"))
    first = seen.withColumn("position", rank - 1).where(F.col("position") < limit)
    return first.join(F.broadcast(totals), "field").select(
        "field", "position", "value", "total", (F.col("total") > limit).alias("truncated")
    )


def _distinct_in_order(rows: Column, field: str, df: DataFrame) -> Column:
    if field not in df.columns:
        return F.array().cast("array<string>")
    kind = df.schema[field].dataType
    if isinstance(kind, T.ArrayType):
        values = F.flatten(F.filter(F.transform(rows, lambda r: F.transform(r[field], strip)), lambda v: v.isNotNull()))
    elif field == "slot":
        def slot(r: Column) -> Column:
            n = r[field].cast("double") if isinstance(kind, T.NumericType) else to_double(r[field])
            return F.when(n >= 0, F.floor(n).cast("bigint")).cast("string")

        values = F.transform(rows, slot)
    else:
        values = F.transform(rows, lambda r: strip(r[field].cast("string")))
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(kept)


def verified_answer(
    spark: SparkSession,
    prompt: str,
    text: str,
    tables: dict[str, DataFrame],
    table: str,
    limit: int = DEFAULT_ROWS,
    executed_at: str = "",
    report: bool = False,
) -> DataFrame:
    """One row: answer, suggestion, evidence and, for reports, verdict and findings.

    The result is capped at 1,000 rows before it is gathered, so the single
    aggregation that reads it is small whatever the tables hold.
    """
    sql = guard_one(spark, text)
    if report:
        hit = spark.range(1).select(references_table(F.lit(sql), table).alias("ok")).first()["ok"]
        if not hit:
            raise ValueError(f"strict mode requires querying table `{table}`")
    limit = min(limit if limit > 0 else DEFAULT_ROWS, MAX_ROWS)
    # One row more than asked for tells whether the answer was clipped.
    result = run_guarded(spark, sql, tables).limit(limit + 1)
    row = F.struct(F.monotonically_increasing_id().alias("_position"), *[F.col(c) for c in result.columns])
    rows = result.select(row.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("_rows")).select(
        F.slice("_rows", 1, limit).alias("rows"), (F.size("_rows") > limit).alias("truncated")
    )
    first = F.get("rows", F.lit(0))
    kpis = _numeric_fields(result, first, sorted(result.columns))
    lead = F.get(_numeric_fields(result, first, result.columns), F.lit(0))["value"]
    n, ask = F.size("rows"), F.lit(prompt)
    names = sorted(result.columns)
    single = (
        F.format_string("Query returned one row: %s=%s.", F.lit(names[0]), first[names[0]].cast("string"))
        if len(names) == 1
        else F.lit(f"Query returned one row with fields: {', '.join(names)}.")
    )
    answer = (
        F.when(n == 0, "No matching rows were found for this query.")
        .when(n == 1, single)
        .otherwise(F.format_string("Query returned %d rows.", n))
    )
    made = rows.select(
        F.lit(sql).alias("sql"),
        sql_hash(F.lit(sql)).alias("sql_hash_sha256"),
        F.lit(table).alias("table"),
        F.lit(executed_at).alias("executed_at_utc"),
        F.lit(limit).alias("row_limit"),
        n.alias("row_count"),
        "truncated",
        *[
            made
            for field in ("program_id", "signature", "slot")
            for values in [_distinct_in_order(F.col("rows"), field, result)]
            for made in (F.slice(values, 1, MAX_VALUES).alias(f"{field}s"), F.size(values).alias(f"{field}_total"))
        ],
        F.transform(F.slice("rows", 1, SAMPLE_ROWS), lambda r: F.to_json(r.dropFields("_position"))).alias(
            "sample_rows"
        ),
        answer.alias("verified_answer"),
        suggested_comparator(ask).alias("suggested_comparator"),
        suggested_threshold(ask, lead).alias("threshold_hint"),
        kpis.alias("kpis"),
    )
    return _with_report(made, prompt, table, limit) if report else made.drop("kpis")


def _with_report(made: DataFrame, prompt: str, table: str, limit: int) -> DataFrame:
    n, k = F.col("row_count"), F.size("kpis")
    top = F.get("kpis", F.lit(0))
    # Summary sentence of each verdict.
    sentences = {
        "insufficient_data": "Query executed, but data is insufficient for a confident ops/growth conclusion.",
        "critical": "Query executed and indicates a critical metric condition that should trigger immediate follow-up.",
        "watch": "Query executed and indicates a watch-level condition; monitor closely.",
        "healthy": "Query executed and metrics appear healthy for the requested scope.",
    }
    spoken = F.lit("Query executed successfully with verified evidence.")
    for verdict, sentence in sentences.items():
        spoken = F.when(F.col("verdict") == verdict, sentence).otherwise(spoken)
    findings = F.array(
        F.lit(f"Executed read-only query against `{table}` with limit={limit}."),
        F.format_string("Returned %d row(s).", n),
        F.when(k > 0, F.format_string("Top KPI `%s` has value %.4f.", top["metric"], top["value"])).otherwise(
            "No numeric KPI fields were detected in the result set."
        ),
    )
    return (
        made.withColumn("question", F.lit(prompt))
        .withColumn("verdict", report_verdict(F.lit(prompt), n, k, top["value"]))
        .withColumn("confidence", report_confidence(n, k))
        .withColumn("findings", findings)
        .withColumn("executive_summary", spoken)
        .withColumn("verified_answer", F.col("executive_summary"))
        # The parts of a report that do not depend on its rows.
        .withColumn("report_version", F.lit("1.0"))
        .withColumn("audience", F.lit("ops_growth_agents"))
        .withColumn(
            "recommended_actions",
            F.array(F.lit("Review suggested automation and tune threshold before activating in production.")),
        )
        .withColumn(
            "recommended_automation",
            F.struct(
                F.lit("Auto monitor from query").alias("name"),
                F.col("sql").alias("query_template"),
                F.col("suggested_comparator").alias("comparator"),
                "threshold_hint",
                *[F.lit(m).alias(c) for c, m in (("schedule_minutes", 60), ("window_minutes", 60), ("cooldown_minutes", 30))],
            ),
        )
        .withColumn(
            "verification",
            F.struct(
                F.lit(True).alias("strict_verified"),
                F.array(
                    F.lit("single read-only statement"), F.lit("no SQL comments"),
                    F.lit("execution evidence attached"), F.lit("table reference validated"),
                ).alias("checks"),
            ),
        )
    )
