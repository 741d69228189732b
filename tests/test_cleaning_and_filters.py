from datetime import date

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import cleaning as C
from gridpulse.functions import codes as K
from gridpulse.functions.metrics import map_to_columns, metric_key, metric_map
from gridpulse.operators import filters as L


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("text,want", [(" 1,5 ", 1.5), ("", None), ("x", None), ("2.25", 2.25)])
def test_decimal_number(spark, text, want):
    assert one(spark, C.decimal_number("t"), t=text) == want


def test_bad_timestamp_is_null(spark):
    frame = spark.createDataFrame([("2024-02-30",), ("2024-02-29 10:00:00",)], "t string")
    rows = C.with_time_parts(frame, "t").collect()
    assert rows[0]["day"] is None and rows[1]["period"] == "2024-02" and rows[1]["day_of_month"] == 29


def test_impossible_parts_give_null(spark):
    frame = spark.createDataFrame([("2024", "2", "30", "1", "1", "1"), ("2024", "2", "29", "1", "1", "1")], "y string, m string, d string, h string, i string, s string")
    rows = [r[0] for r in frame.select(C.timestamp_from_parts("y", "m", "d", "h", "i", "s")).collect()]
    assert rows[0] is None and rows[1].day == 29


def test_alias_resolver_ignores_case_and_falls_through(spark):
    frame = spark.createDataFrame([(None, "b")], "` Circuito ` string, FPARENT string")
    assert frame.select(C.resolve_alias(frame, ["CIRCUITO", "fparent"], "Sin circuito").alias("o")).first()["o"] == "b"
    assert frame.select(C.resolve_alias(frame, ["none"], "Sin circuito").alias("o")).first()["o"] == "Sin circuito"


def test_risk_score_bounds(spark):
    frame = spark.createDataFrame([(None, None), (500.0, 500.0), (-5.0, None), (50.0, 50.0)], "a double, b double")
    score, label = C.numeric_risk(["a", "b"])
    assert [tuple(r) for r in frame.select(score, label).collect()] == [(0.5, "high_risk"), (1.0, "high_risk"), (0.0, "low_risk"), (0.5, "high_risk")]


def test_row_text_skips_blank_cells(spark):
    frame = spark.createDataFrame([("x", " ", None, 3)], "a string, b string, c string, d int")
    assert frame.select(C.row_as_text(frame).alias("o")).first()["o"] == "a: x | d: 3"


def test_drop_columns_with_null(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert C.drop_columns_with_null(frame).columns == ["a"]


def test_metric_map_round_trip(spark):
    assert metric_key(" users ") == "USERS" and metric_key("bad") == "UITI" and metric_key(None) == "UITI"
    frame = spark.createDataFrame([(1.0, None, 3, 4.0, 5.0)], "uiti_total double, uiti_vano_total double, event_count int, users_affected_total double, duration_raw_total double")
    row = map_to_columns(frame.select(metric_map().alias("metrics"))).first()
    assert (row["UITI"], row["UITI_VANO"], row["EVENT_COUNT"]) == (1.0, 0.0, 3.0)


def test_unknown_codes_stay(spark):
    rows = spark.createDataFrame([("7",), ("46",), (None,)], "c string").select(K.code_text("c", K.PHASES)).collect()
    assert [r[0] for r in rows] == ["3", "46", None]


def test_pole_rules(spark):
    frame = spark.createDataFrame(
        [("FACHADA", "F", None, None, None, "A", 1.0, None), ("N1", "F", "T", None, None, "B", 2.0, "P"), ("N1", "G", None, 8.0, "x", "Z", 1.0, "C")],
        "assembly string, pole_class string, material string, pole_length double, grounding string, primary_guy string, secondary_guy double, owner_type string",
    )
    rows = K.pole_attributes(frame).collect()
    assert (rows[0]["material"], rows[0]["guys"], rows[0]["grounding"], rows[0]["pole_length"], rows[0]["owner_type"]) == ("No aplica", "No aplica", "No aplica", "6.0", "C")
    assert (rows[1]["material"], rows[1]["guys"], rows[1]["grounding"], rows[1]["pole_length"]) == ("Poste en Concreto", "13.0", "0", "No aplica")
    assert (rows[2]["material"], rows[2]["guys"], rows[2]["pole_length"]) == (None, None, "8.0")


def test_event_eligibility_precedence(spark):
    frame = spark.createDataFrame(
        [("NP", "13.2", "x", 5.0), ("P", "13.2", "x", 5.0), ("P", "TFD", "x", 5.0), ("P", "TFP", K.EXCLUDED_CAUSES[0], 5.0), ("P", "TFP", None, 120.0), ("NP", "33", "x", 120.5)],
        "t string, e string, c string, h double",
    )
    rows = frame.select(K.eligible_event(F.col("t"), F.col("e"), F.col("c"), F.col("h")).alias("k")).collect()
    assert [r["k"] for r in rows] == [True, False, True, False, True, False]


def test_window_coercion():
    low, high = date(2023, 1, 1), date(2024, 6, 30)
    assert L.coerce_window(None, None, low, high) == (date(2024, 1, 3), high)
    assert L.coerce_window("2024-03-01", "2024-01-01", low, high) == (date(2024, 1, 1), date(2024, 3, 1))
    assert L.coerce_window("2020-01-01", "2030-01-01", low, high) == (low, high)


def test_circuit_choices(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "circuit string")
    assert L.choose_circuits(frame, None).count() == 3 and L.choose_circuits(frame, ["Todos"]).count() == 3
    assert L.choose_circuits(frame, []).count() == 0 and L.choose_circuits(frame, [" a", "a "]).count() == 1


def test_typed_filters_skip_bad_rows(spark):
    frame = spark.createDataFrame([(1, 2.5, date(2024, 1, 5)), (2, 9.0, date(2024, 2, 5))], "i int, x double, d date")
    keep = [["fecha", "d", "2024-01-31", "2024-01-01"], ["rango_num", "x", "drop table", 1], ["seleccion", "i", None, None], ["seleccion", "zz", "1", None], ["rango_num", "x", "<", "abc"]]
    assert [r["i"] for r in L.apply_filters(frame, keep).collect()] == [1]
    assert L.condition_text("x", "Eventos", [["rango_num", "x", "<", 3]]) == "P(x | Eventos, x < 3)"
    assert [L.filter_kind(k) for k in ("int", "string", "double", "decimal(4,2)", "timestamp")] == ["seleccion", "seleccion", "rango_num", "rango_num", "fecha"]


def test_coordinate_gate(spark):
    good = spark.createDataFrame([(1.0, 2.0)] * 19 + [(500.0, 2.0)], "x double, y double")
    assert L.lon_lat_share(good, ["x"], ["y"]).first()["lon_lat_ok"] is True
    assert L.lon_lat_share(good.limit(0), ["x"], ["y"]).first()["lon_lat_ok"] is False
