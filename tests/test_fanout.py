from slotwise.operators import fanout, normalize

ROUTES = "route_id long, url string, program_id string, event_type string, is_active boolean"


def routes(spark, rows):
    return normalize.load_routes(spark.createDataFrame(rows, ROUTES))


BASE = [
    (1, "https://x/program", "ProgramA", "transaction", True),
    (2, "https://x/all", "", " ", True),
    (3, "https://x/program", "ProgramA", "transaction", True),
    (4, "https://x/other", "ProgramB", "transaction", True),
    (5, "https://x/off", "ProgramA", "", False),
]


def event(spark, program="ProgramA", kind="transaction"):
    return spark.createDataFrame([("event-1", program, kind)], "event_id string, program_id string, event_type string")


def targets(df):
    return sorted((r["route_id"], r["url"], r["source"]) for r in df.collect())


def test_duplicate_urls_and_static(spark):
    for limit in (100, 0):  # look-up and shuffle paths
        made = fanout.matched_routes(event(spark), routes(spark, BASE), "https://x/program", True, limit)
        assert targets(made) == [("1", "https://x/program", "registry"), ("2", "https://x/all", "registry")]


def test_static_alone(spark):
    for limit in (100, 0):
        made = fanout.matched_routes(event(spark, "Z"), routes(spark, BASE[3:4]), "https://x/s", True, limit)
        assert targets(made) == [("static-env", "https://x/s", "env")]
        assert targets(fanout.matched_routes(event(spark, "Z"), routes(spark, BASE[3:4]), None, True, limit)) == []


def test_both_paths_agree(spark):
    from slotwise.plans.inputs import shape

    sf = "/root/testdata/sf0.001"
    events = shape(spark, sf, "chain_events").select("event_id", "program_id", "event_type")
    table = normalize.load_routes(shape(spark, sf, "routes"))
    for unique in (False, True):
        a = fanout.matched_routes(events, table, "https://hook3.example/in", unique)
        b = fanout.matched_routes(events, table, "https://hook3.example/in", unique, limit=0)
        assert a.count() > 1000
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_odd_events_on_both_paths(spark):
    """No program, no type, a program named like the wildcard, and an event delivered twice."""
    events = spark.createDataFrame(
        [("a", None, "transaction"), ("b", "ProgramA", None), ("c", "*", "transaction"), ("d", "ProgramA", "transaction"),
         ("d", "ProgramA", "transaction")],
        "event_id string, program_id string, event_type string",
    )
    table = routes(spark, [*BASE, (6, "https://x/all", "", "transaction", True), (7, "https://x/star", "*", "", True)])
    for unique in (False, True):
        found = []
        for limit in (100, 0):
            made = fanout.matched_routes(events, table, "https://x/s", unique, limit)
            found.append(sorted((r["event_id"], r["route_id"]) for r in made.collect()))
        assert found[0] == found[1]
        by = {e: [r for x, r in found[0] if x == e] for e in "abcd"}
        assert by["a"] == (["2", "static-env"] if unique else ["2", "6", "static-env"])
        assert by["b"] == ["2", "static-env"]
        assert by["c"] == (["2", "7", "static-env"] if unique else ["2", "6", "7", "static-env"])
        one = ["1", "2", "static-env"] if unique else ["1", "2", "3", "6", "static-env"]
        assert by["d"] == sorted(one * 2)


def test_blank_url_fails_the_load(spark):
    import pytest

    with pytest.raises(Exception, match="blank url"):
        routes(spark, [(1, " ", "", "", True)]).collect()


def test_many_free_routes_in_slices(spark, monkeypatch):
    """Beyond the limit routes without any filter go in slices; urls stay unique across slices and keys."""
    monkeypatch.setattr(fanout, "WILD_SLICE", 3)
    rows = [(i, f"https://x/{i % 17}", "ProgramA" if i % 5 == 0 else "", "transaction" if i % 7 == 0 else "", True) for i in range(60)]
    events = spark.createDataFrame(
        [(str(i), p, k) for i, (p, k) in enumerate([("ProgramA", "transaction"), ("Z", None), (None, "account"), ("ProgramA", "x")] * 2)],
        "event_id string, program_id string, event_type string",
    )
    table = routes(spark, rows)
    for unique in (False, True):
        for static in (None, "https://x/3", "https://x/s"):
            both = [
                sorted(map(tuple, fanout.matched_routes(events, table, static, unique, limit).collect()), key=str) for limit in (100, 0)
            ]
            assert both[0] == both[1] and len(both[0]) > 8 * 10
    text = fanout.matched_routes(events, table, None, True, 0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
