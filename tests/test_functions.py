import hashlib
import hmac

import pytest

from pyspark.sql import functions as F

from slotwise.functions import scoring, signing, text, timing
from slotwise.operators import guard


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_growth_ratio(spark):
    df = spark.createDataFrame([(100.0, 250.0), (0.0, 0.0), (0.0, 12.0), (50.0, 10.0)], "b double, e double")
    got = [r[0] for r in df.select(scoring.growth_ratio(F.col("b"), F.col("e"))).collect()]
    assert got == [2.5, 1.0, 12.0, 0.2]


def test_bands_and_clamp(spark):
    assert column(spark, [0.8, 0.6, 0.2, 0.75, 0.45], scoring.probability_band, "double") == [
        "high", "medium", "low", "high", "medium",
    ]
    assert column(spark, [-1.0, 0.5, 3.0], lambda c: scoring.clamp(c, 0.01, 0.99), "double") == [0.01, 0.5, 0.99]


def test_guard_accepts_and_cleans(spark):
    assert guard.guard_one(spark, "```sql\nSELECT count(*) FROM chain_events FORMAT JSONEachRow\n```;") == (
        "SELECT count(*) FROM chain_events"
    )


def test_guard_reasons(spark):
    texts = {
        "DELETE FROM t": "only read-only SELECT queries are allowed",
        "SELECT 1; SELECT 2": "multiple statements are not allowed",
        "SELECT 1 -- x": "sql comments are not allowed",
        "SELECT /* x */ 1": "sql comments are not allowed",
        "SELECT 'please drop it'": "query contains unsupported keywords",
        "```SELECT 1;```": "multiple statements are not allowed",
        " ; ": "sql query is empty",
        "selectx from t": None,
        "select droplet, éupdate_ from t": None,
        "select é-drop": "query contains unsupported keywords",
        "select 'édrop'": "query contains unsupported keywords",
        "WITH a AS (SELECT 1) SELECT * FROM a": None,
    }
    df = guard.guard_texts(spark.createDataFrame([(t,) for t in texts], "q string"), "q")
    assert {r["q"]: r["reject_reason"] for r in df.collect()} == texts


def test_table_reference(spark):
    hit = lambda t: column(spark, ["select * from Chain_Events", "from chain_events2"], lambda c: guard.references_table(c, t))
    assert hit("chain_events") == [True, False]
    assert hit(" ") == [True, True]


def test_numbers(spark):
    given = [" 12.5 ", "1d", "1e3", "", "abc", "-.5", "1e999", "inf", "5."]
    assert column(spark, given, text.to_double) == [12.5, None, 1000.0, None, None, -0.5, None, float("inf"), 5.0]


def test_stage_names(spark):
    given = [" SQL.Validation ", "", "  ", "a-b_c9", None, "é"]
    assert column(spark, given, text.sanitize_stage) == ["sql_validation", "unknown", "unknown", "a-b_c9", "unknown", "_"]


def test_strip_all_white_space(spark):
    assert column(spark, ["\t 　x y\r\n "], text.strip) == ["x y"]


def test_base58_and_names(spark):
    assert column(spark, ["abc", "0bc", " abc ", "", "abc\nx"], text.is_base58) == [True, False, True, False, False]
    assert column(spark, ["a.b:c-d_9", "a b", "a\n"], text.is_identifier) == [True, False, False]


def test_urls(spark):
    given = ["https://a.b/c", "HTTP://a", "ftp://a", "https://", "https:///x", "http://:80", "http://u@h", "http://u@/",
             "http://[::1]:8/x", "http://a/%zz", "http://a/?q=%zz", "http://a b/"]
    assert column(spark, given, text.is_http_url) == [
        True, True, False, False, False, True, True, False, True, False, True, False,
    ]


def test_signature_equals_hmac(spark):
    for secret in ("short", "x" * 100):
        df = spark.createDataFrame([("1700000000", "n1", '{"a":"é"}')], "t string, n string, b string")
        got = df.select(signing.request_signature(secret, F.col("t"), F.col("n"), F.col("b"))).first()[0]
        body = '1700000000\nn1\n{"a":"é"}'.encode()
        assert got == hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def test_times(spark):
    given = ["2024-01-05T12:00:00Z", "2024-01-05T12:00:00.75+02:00", "2024-01-05", "not-a-time", "2024-13-05T12:00:00Z"]
    assert column(spark, given, lambda c: timing.rfc3339(timing.parse_rfc3339(c))) == [
        "2024-01-05T12:00:00Z", "2024-01-05T10:00:00Z", None, None, None,
    ]
    unix = column(spark, [" 1700000000 ", "x"], lambda c: F.unix_seconds(timing.parse_unix_or_rfc3339(c)))
    assert unix == [1700000000, None]


def test_base64_has_no_line_breaks(spark):
    long = "x" * 300
    assert "\n" not in column(spark, [long], lambda c: signing.plain_base64(F.encode(c, "UTF-8")))[0]


def test_guard_keeps_to_tables(spark):
    from slotwise.operators import guard

    spark.range(9).createOrReplaceTempView("secret")
    tables = {"five": spark.range(5)}
    for text, rows in (
        ("select * from five", 5), ("SELECT f.id FROM Five f JOIN `five` g ON f.id = g.id WHERE EXISTS (SELECT 1 FROM five)", 5),
        ("with q as (select id + 1 as n from five) select sum(n) over (order by n), date_trunc('hour', timestamp_seconds(n)) from q", 5),
        ("select explode(array(1, 2)) union all select * from values (3)", 3),
    ):
        assert guard.guarded_query(spark, text, tables).count() == rows
    for text, reason in (
        ("select * from text.`/etc/hostname`", "table is not allowed: text, /etc/hostname"),
        ("select * from five where id in (select id from secret)", "table is not allowed: secret"),
        ("with q as (select * from secret) select * from q", "table is not allowed: secret"),
        ("select * from (with secret as (select 1) select * from secret) join secret", "name is taken by a table: secret"),
        ("select * from default.five", "table is not allowed: default, five"),
        ("select reflect('java.util.UUID', 'randomUUID')", "function is not allowed: reflect"),
        ("select try_reflect ('a.b', 'c') from five", "function is not allowed: try_reflect"),
        ("select current_user()", "function is not allowed"), ("select version() from five", "function is not allowed: version"),
        ("select * from range(3)", "query part is not allowed: UnresolvedTableValuedFunction"),
        ("select transform(id) using 'cat' as (x) from five", "query part is not allowed: ScriptTransformation"),
        ("select * from identifier('sec' || 'ret')", "query part is not allowed"),
        ("select (from five", "query cannot be parsed"),
    ):
        with pytest.raises(ValueError, match=reason.replace("(", r"\(").replace("|", r"\|")):
            guard.guarded_query(spark, text, tables)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_guarded")]


def test_subjects_see_their_rows(spark):
    from slotwise.operators import guard

    rows = spark.createDataFrame([("A", 1), (" A ", 2), ("B", 3), ("", 4), (None, 5)], "program_id string, n int")
    grants = spark.createDataFrame(
        [("one", "viewer", ["A"]), ("one", "viewer", ["C"]), ("all", "viewer", []), ("boss", " Admin", ["C"]), ("none", "viewer", ["Z"])],
        "subject string, role string, programs array<string>",
    )
    seen = {}
    for who in ("one", "all", "boss", "none", "stranger"):
        views = guard.subject_tables({"t": rows, "free": spark.range(2)}, grants, who)
        seen[who] = sorted(r[0] for r in guard.guarded_query(spark, "SELECT n FROM t", views).collect())
        assert guard.guarded_query(spark, "SELECT * FROM free", views).count() == 2
    assert seen == {"one": [1, 2, 4, 5], "all": [1, 2, 3, 4, 5], "boss": [1, 2, 3, 4, 5], "none": [4, 5], "stranger": []}


def test_clipped_answers_say_so(spark):
    from slotwise.operators import guard

    tables = {"t": spark.range(250).selectExpr("id AS slot", "concat('p', id % 120) AS program_id")}
    row = guard.verified_answer(spark, "", "select * from t", tables, "t", 200).first()
    assert row["row_count"] == 200 and row["truncated"] and (len(row["slots"]), row["slot_total"]) == (100, 200)
    assert (len(row["program_ids"]), row["program_id_total"], row["signature_total"]) == (100, 120, 0)
    assert not guard.verified_answer(spark, "", "select * from t", tables, "t", 250).first()["truncated"]
    made = {r["field"]: (r["total"], r["truncated"]) for r in guard.evidence_values(tables["t"], ["slot"], 150).collect()}
    assert made == {"slot": (250, True), "program_id": (120, False)}


def test_registry_changes_and_versions(spark):
    from slotwise.functions.identity import registry_version
    from slotwise.operators import registry

    texts = spark.createDataFrame([('{"version":25}',), ('{"version":"25"}',), ('{"version":null}',), ("{}",), ("oops",)], "c string")
    assert [r["v"] for r in texts.select(registry_version(F.col("c")).alias("v")).collect()] == ["25", '"25"', "null", None, None]
    base = spark.createDataFrame([("p1", "a", "{}"), ("p2", "b", "{}")], "program_id string, name string, content string")
    base = base.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    changes = spark.createDataFrame(
        [("p1", "update", "x", None), ("p1", "delete", None, None), ("p2", "update", "y", None)],
        "program_id string, action string, name string, content string",
    )
    merged = registry.merge_registry(base, changes, "2024-02-01T00:00:00Z")
    got = {r["program_id"]: (r["name"], r["result"], r["updated_at"].month) for r in merged.collect()}
    assert got == {"p1": ("a", "conflict", 1), "p2": ("y", "updated", 2)}
    assert registry.snapshot(merged).count() == 2


def test_evidence_without_its_fields_is_empty(spark):
    from slotwise.operators import guard

    df = spark.createDataFrame([(1,)], "n long")
    assert guard.evidence_values(df, ["n"]).count() == 0
