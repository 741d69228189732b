import pytest
from pyspark.sql import functions as F

from gridpulse.operators import aggregates as A
from gridpulse.operators import joins as J
from gridpulse.operators import quality as Q
from gridpulse.operators import reshape as R


def test_validated_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(J.DuplicateKeyError):
        J.validated_join(left, right, ["k"])
    one = right.limit(1)
    assert J.validated_join(left, one, ["k"]).count() == 2
    with pytest.raises(J.DuplicateKeyError):
        J.validated_join(left, one, ["k"], "one_to_one")


def test_missing_keys_treats_null_as_equal(spark):
    child = spark.createDataFrame([(1,), (None,), (3,), (3,)], "k int")
    parent = spark.createDataFrame([(1,), (None,)], "p int")
    assert [r["k"] for r in J.missing_keys(child, parent, {"k": "p"}).collect()] == [3]


def test_snapshot_join_drops_only_unmatched_layered_types(spark):
    events = spark.createDataFrame(
        [("e1", "interruptor", "S1", "2024-03-05"), ("e2", "interruptor", "S9", "2024-03-05"), ("e3", "otro", "S1", "2024-03-05"), ("e4", "transformador", "T1", "2024-04-01")],
        "event_id string, equipment_type string, equipment string, d string",
    ).withColumn("event_ts", F.to_timestamp("d"))
    sw = spark.createDataFrame([("S1", "2024-03-31", 3)], "code string, d string, phases int").withColumn("d", F.to_date("d"))
    tr = spark.createDataFrame([("T1", "2024-04-15", 2, 25.0)], "code string, d string, phases int, kva double").withColumn("d", F.to_date("d"))
    layers = [J.SnapshotLayer("interruptor", sw, "code", "d", {"phases": "phases"}), J.SnapshotLayer("transformador", tr, "code", "d", {"phases": "phases", "kva": "kva"})]
    got = {r["event_id"]: (r["phases"], r["kva"]) for r in J.snapshot_join(events, layers).collect()}
    assert got == {"e1": (3, None), "e3": (None, None), "e4": (2, 25.0)}


def test_wildcard_rules_and_catalogue(spark):
    rules = spark.createDataFrame(
        [("r1", 0.85, ["TEMP_*", "DDT"], ["NR_T"]), ("r2", 0.9, ["X?"], ["none"])], "rule_id string, weight double, origin array<string>, destination array<string>"
    )
    names = spark.createDataFrame([("temp_0",), ("Temp_12",), ("nr_t",), ("x12",)], "name string")
    rows = J.wildcard_rules(rules, names).collect()
    assert [tuple(r) for r in rows] == [("r1", 0.85, ["Temp_12", "temp_0"], ["nr_t"])]
    catalogue = spark.createDataFrame([("DURACION", "A", ["duration_raw"]), ("CIRCUITO", "C", ["circuito"])], "variable string, mode_id string, aliases array<string>")
    found, modes = J.catalogue_match(catalogue, spark.createDataFrame([("duration_raw",)], "name string"))
    assert found.first()["variable"] == "DURACION" and [tuple(r) for r in modes.collect()] == [("A", ["DURACION"])]


def test_lookback_counts_from_midnight_of_the_day_before(spark):
    events = spark.createDataFrame([("v", "e", "2024-05-02 15:00:00")], "k string, e string, s string").withColumn("ts", F.to_timestamp("s"))
    readings = spark.createDataFrame(
        [("v", "2024-05-01 00:00:00", 1.0), ("v", "2024-05-01 23:00:00", 2.0), ("v", "2024-05-02 00:00:00", 9.0), ("v", "2024-04-30 23:00:00", 8.0)], "k string, s string, temp double"
    ).withColumn("at", F.to_timestamp("s"))
    row = J.lookback_hours(events, readings, "k", "e", "ts", "at", ["temp"]).first()
    assert row["h0-temp"] == 1.0 and row["h23-temp"] == 2.0 and row["h12-temp"] is None
    long = J.lookback_hours(events, readings, "k", "e", "ts", "at", ["temp"], hours=48).first()
    assert long["h24-temp"] == 9.0


def test_code_history_lookup_conflicts_and_coverage(spark):
    history = spark.createDataFrame(
        [("A1", "Viejo", "2023-01-01"), ("A1", "Nuevo", "2024-01-01"), ("A2", "Unico", "2023-01-01"), ("A3", " ", "2023-01-01")], "CODE string, MUN string, FECHA string"
    )
    clean = history.where("trim(MUN) <> ''")
    conflicts = Q.value_conflicts(clean, "CODE", "MUN")
    assert conflicts.select("CODE").distinct().count() == 1
    latest = J.latest_by_key(clean, ["CODE"], [F.desc("FECHA")], ["CODE", "MUN"])
    spans = spark.createDataFrame([("v1", "s1"), ("v2", "s2"), ("v3", "s3")], "FID string, SUP string")
    supports = spark.createDataFrame([("s1", "A1"), ("s2", "A2"), ("s3", "A3")], "SUP string, CODE string")
    out = J.two_hop_lookup(spans, supports, latest, "FID", "SUP", "CODE", "MUN", "supports:CODE")
    got = {r["FID"]: (r["MUN"], r["MUN_source"], r["MUN_confidence"]) for r in out.collect()}
    assert got["v1"] == ("Nuevo", "supports:CODE", "direct_code") and got["v3"] == (None, None, "unresolved")
    row = J.coverage(out, F.col("MUN")).first()
    assert (row["rows"], row["resolved_rows"], row["coverage"]) == (3, 2, 0.666667)
    with pytest.raises(J.CoverageError):
        J.coverage(out, F.col("MUN"), 0.9)


def test_normalise_and_rebuild(spark):
    wide = spark.createDataFrame(
        [(1, "v1", "x", "c1", "", 1.0), (2, "v1", "x", "c2", "k", 2.0), (3, "v2", "y", "c1", "", 3.0)], "row_id int, span string, kind string, cause string, note string, impact double"
    )
    tables = R.normalise(wide, "row_id", {"spans": ["span", "kind"]}, {"events": ("event_id", ["cause", "note"], "EVT_")})
    ids = {r["event_id"]: r["cause"] for r in tables["events"].collect()}
    assert ids == {"EVT_000001": "c1", "EVT_000002": "c2"}
    rebuilt = tables["fact"].join(tables["events"], "event_id").join(tables["spans"], "span")
    assert R.reconstruction_gap(wide, rebuilt).count() == 0
    assert R.reconstruction_gap(wide, rebuilt.where("row_id < 3")).count() == 1


def test_weather_round_trip(spark):
    wide = spark.createDataFrame([("v", "d", 1.0, None, 3.0, 4.0)], "k string, d string, temp_0 double, temp_1 double, rh_0 double, rh_1 double")
    long = R.wide_to_long(wide, ["k", "d"], ["temp", "rh"], range(2))
    assert long.count() == 2
    assert R.reconstruction_gap(wide, R.long_to_wide(long, ["k", "d"], ["temp", "rh"], range(2))).count() == 0


def test_key_checks_and_report(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    row = Q.key_counts(frame, ["k"]).first()
    assert tuple(row) == (4, 1, 1, 2)
    assert Q.dependency_violations(frame, ["k"], ["v"]).count() == 1
    report = Q.validation_report({"t": frame}, [Q.TableSpec("t", ["k", "z"], primary_key=["k"])])
    assert {r["check"] for r in report.where("status = 'FAIL'").collect()} == {"required_columns", "primary_key_unique", "primary_key_not_null"}
    with pytest.raises(Q.ValidationFailure):
        Q.require_passing(report)


def test_profile_of_all_null_and_empty(spark):
    rows = {r["column"]: r for r in Q.profile(spark.createDataFrame([(1, None), (2, None)], "a int, b string")).collect()}
    assert rows["b"]["null_percent"] == 100.0 and rows["b"]["distinct_count"] == 0 and rows["a"]["distinct_count"] == 2
    assert Q.profile(spark.createDataFrame([], "a int")).first()["null_percent"] == 0.0


def test_fill_from_latest_and_corrections(spark):
    rows = spark.createDataFrame([("e", "", 3), ("e", "old", 1), ("e", "new", 2), ("f", None, 1), ("g", " ", 1)], "k string, c string, t int")
    fixes = spark.createDataFrame([("f", "fix")], "k string, c string")
    got = sorted((r["k"], r["t"], r["c"]) for r in R.fill_from_latest(rows, "k", "c", "t", fixes).collect())
    assert got == [("e", 1, "old"), ("e", 2, "new"), ("e", 3, "new"), ("f", 1, "fix"), ("g", 1, None)]


def test_event_options_and_rollups(spark):
    fact = spark.createDataFrame(
        [("e1", "2024-01-01", 1.0, 0.3, 2.0, 4.0), ("e1", "2024-01-01", 1.0, 0.1, 2.0, 4.0), ("e2", "2024-01-02", 2.0, 0.1, 1.0, 1.0)],
        "event_id string, day string, event_impact double, span_impact double, duration double, users double",
    )
    rows = {r["day"]: r for r in A.two_level_daily(fact).collect()}
    assert rows["2024-01-01"]["UITI"] == 1.0 and rows["2024-01-01"]["UITI_VANO"] == pytest.approx(0.4) and rows["2024-01-01"]["EVENT_COUNT"] == 1
    totals = A.window_totals(fact.limit(0), {"UITI": "event_impact"}).first()
    assert totals["UITI"] == 0.0


def test_strike_summary_tie_takes_smallest_name(spark):
    frame = spark.createDataFrame([("k", 1.0, "IC", "b"), ("k", 3.0, "CG", "a"), ("k", None, "CG", None)], "g string, v double, t string, n string")
    row = A.strike_summary(frame, ["g"], "v", "t", ["CG"], "n").first()
    assert row["median_value"] == 2.0 and row["n_CG"] == 2 and row["strikes"] == 3


def test_map_extent_uses_first_filled_layer(spark):
    empty = spark.createDataFrame([], "latitude double, longitude double")
    lines = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "latitude double, longitude double, latitude_end double, longitude_end double")
    row = A.map_extent([empty, lines]).first()
    assert row["layer"] == 1 and row["center_lat"] == 2.0 and row["max_lon"] == 4.0


def test_pattern_trie_equals_the_shell_rules():
    import fnmatch
    import itertools

    from gridpulse.operators.patterns import PatternTrie

    patterns = ["temp_*", "T?mp_1", "[a-c]x*", "[!a-c]x", "plain", "*", "a[", "a[b", "*_[0-9]", "te[mn]p_*", "", "viento.*"]
    names = ["TEMP_1", "TEMP_", "AX", "DX", "BXY", "PLAIN", "A[", "A[B", "TENP_X", "", "VIENTO.1", "VIENTOX1", "Z_7"]
    trie = PatternTrie(patterns)
    for name, (i, pattern) in itertools.product(names, enumerate(patterns)):
        assert (i in trie.matches(name)) == fnmatch.fnmatchcase(name, pattern.upper())


def test_rule_matches_are_rows(spark):
    from gridpulse.operators.patterns import rule_matches

    rules = spark.createDataFrame([("r1", 0.51234, ["TEMP_[0-9]", "wind*"], ["UITI"]), ("r2", 1.0, ["none"], None)], "rule_id string, weight double, origin array<string>, destination array<string>")
    names = spark.createDataFrame([("temp_3",), ("temp_x",), ("Wind",), (" uiti ",), (None,)], "name string")
    out = rule_matches(rules, names)
    assert {tuple(r) for r in out.collect()} == {("r1", 0.5123, "origin", "temp_3"), ("r1", 0.5123, "origin", "Wind"), ("r1", 0.5123, "destination", " uiti ")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan
