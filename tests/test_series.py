from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import series as S
from gridpulse.plans.interpret import critical_points, insight_lines, plain_number, retrieval_queries

SCHEMA = "s string, day date, UITI double, UITI_VANO double, EVENT_COUNT double, USERS double, DURATION_RAW double"


def daily(spark, values, metric="UITI", skip=()):
    rows = []
    for i, v in enumerate(values):
        if i in skip:
            continue
        u, uv = (v, 0.0) if metric == "UITI" else (0.0, v)
        rows.append(("a", date(2024, 1, 1) + timedelta(days=i), u, uv, 1.0, 0.0, 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def reasons(spark, values, metric="UITI"):
    series = S.zero_filled_daily(daily(spark, values, metric), ["s"])
    out = S.point_reasons(S.series_features(series, ["s"], [metric]), ["s"], metric)
    return {r["day"].day: {x["reason_type"]: x["score"] for x in r["reasons"]} for r in out.collect()}


def test_spike_is_outlier_increase_and_contributor(spark):
    found = reasons(spark, [0.1, 0.2, 9.5, 0.3])
    assert {"uiti_high_outlier", "sharp_uiti_increase", "top_uiti_contributor"} <= set(found[3])
    assert found[3]["uiti_high_outlier"] == 2.0


def test_span_metric_spike(spark):
    found = reasons(spark, [0.5, 0.6, 0.5, 0.4, 0.5, 5.0, 0.5, 0.6, 0.5, 0.4], "UITI_VANO")
    assert {"uiti_vano_high_outlier", "sharp_uiti_vano_increase"} <= set(found[6])


def test_fall(spark):
    found = reasons(spark, [1.0, 1.1, 0.9, 1.0, 1.0, 8.0, 0.2, 1.0, 1.1, 0.9])
    assert any("sharp_uiti_decrease" in r for r in found.values())


def test_sustained_period(spark):
    values = [0.1, 0.1, 0.1, 3.0, 3.1, 3.2, 3.3, 0.1, 0.1, 0.1]
    rows = S.sustained_periods(S.zero_filled_daily(daily(spark, values), ["s"]), ["s"]).collect()
    assert len(rows) == 1 and rows[0]["days"] == 4 and rows[0]["start_date"].day == 4
    assert rows[0]["score"] == pytest.approx(12.6 / 13.2, abs=1e-4)


def test_zero_series_has_no_points(spark):
    series = S.zero_filled_daily(daily(spark, [0.0] * 8), ["s"])
    assert critical_points(series, ["s"]).count() == 0
    assert "all_zero_window" in S.quality_flags(daily(spark, [0.0] * 8).drop("EVENT_COUNT"), ["s"], ["UITI", "UITI_VANO"]).first()["flags"]


def test_negative_and_gap_flags(spark):
    flags = S.quality_flags(daily(spark, [1.0, -1.0, 2.0, 3.0], skip=(2,)), ["s"]).first()["flags"]
    assert {"negative_uiti_values", "missing_dates", "short_window"} <= set(flags)


def test_unattributed_flag(spark):
    none = spark.createDataFrame([], "s string, day date")
    assert "missing_event_attribution" in S.quality_flags(daily(spark, [1.0] * 8), ["s"], events=none).first()["flags"]


def test_gap_is_filled_with_zero(spark):
    rows = S.zero_filled_daily(daily(spark, [1.0, 2.0, 3.0, 4.0], skip=(1,)), ["s"]).orderBy("day").collect()
    assert [r["UITI"] for r in rows] == [1.0, 0.0, 3.0, 4.0]


def test_reversed_window_is_swapped(spark):
    rows = S.zero_filled_daily(daily(spark, [1.0]), ["s"], start="2024-01-03", end="2023-12-31")
    assert rows.count() == 4


def test_two_peaks_rank(spark):
    values = [0.2, 0.3, 0.2, 6.0, 0.2, 0.3, 0.2, 2.0, 0.2, 0.3]
    points = critical_points(S.zero_filled_daily(daily(spark, values), ["s"]), ["s"]).orderBy("rank").collect()
    assert points[0]["day"].day == 4 and points[0]["criticality_score"] <= 10.0


def test_one_peak_in_180_days(spark):
    values = [0.2 + (i % 5) * 0.01 for i in range(180)]
    values[60] = 7.0
    top = critical_points(S.zero_filled_daily(daily(spark, values), ["s"]), ["s"]).where("rank = 1").first()
    assert top["day"] == date(2024, 1, 1) + timedelta(days=60)


def test_rolling_median_needs_enough_rows(spark):
    series = S.zero_filled_daily(daily(spark, [5.0, 1.0, 3.0, 9.0]), ["s"])
    rows = series.select("day", S.rolling_median("UITI", ["s"], "day", 7, 3).alias("m")).orderBy("day").collect()
    assert [r["m"] for r in rows] == [None, None, 3.0, 4.0]


def test_constant_series_has_zero_z(spark):
    rows = S.robust_z(daily(spark, [2.0] * 5), ["s"], {"UITI": "z"}).collect()
    assert {r["z"] for r in rows} == {0.0}


def test_enrichment_and_insight(spark):
    series = S.zero_filled_daily(daily(spark, [0.1, 0.2, 9.5, 0.3]), ["s"])
    points = critical_points(series, ["s"])
    d = date(2024, 1, 3)
    attribution = spark.createDataFrame(
        [("a", d, "viento", 2, 9.0, 9.0, 1.0, 5.0), ("a", d, " ", 1, 0.5, 0.5, 1.0, 1.0)],
        "s string, day date, cause string, event_count int, uiti_total double, uiti_vano_total double, duration_raw_total double, users_affected_total double",
    )
    details = spark.createDataFrame(
        [("a", d, "e1", 1.0, 0.0, 2.0, 1.0), ("a", d, "e2", 0.5, 3.0, 1.0, 1.0)],
        "s string, day date, event_id string, UITI double, UITI_VANO double, DURATION_RAW double, USERS double",
    )
    rich = S.enrich_points(points, attribution, details, ["s", "day"], dimensions=("cause",))
    row = rich.where("rank = 1").first()
    assert [x["label"] for x in row["top_causes"]] == ["viento", "Sin dato"]
    assert [x["event_id"] for x in row["top_events"]] == ["e2", "e1"] and row["confidence"] == "high"
    text = insight_lines(rich, ["s"], "2024-01-01", "2024-01-04").first()["insight"]
    assert "viento (top_causes)" in text and "2024-01-03" in text


def test_days_without_attribution_take_event_rows(spark):
    """Attribution, event rows only, neither, event rows without impact, and a quiet day."""
    days = [date(2024, 1, i) for i in range(1, 6)]
    columns = "s string, day date, rank int, UITI double, UITI_VANO double, EVENT_COUNT double, USERS double, DURATION_RAW double"
    points = spark.createDataFrame([("a", d, i + 1, 10.0, 0.0, 0.0 if i == 4 else 2.0, 0.0, 0.0) for i, d in enumerate(days)], columns)
    sums = "event_count int, uiti_total double, uiti_vano_total double, duration_raw_total double, users_affected_total double"
    attribution = spark.createDataFrame([("a", days[0], "viento", 2, 4.0, 1.0, 1.0, 5.0)], f"s string, day date, cause string, {sums}")
    rows = [("a", days[0], "e1", 1.0, 1.0, 2.0, 1.0, "lluvia"), ("a", days[1], "e2", 6.0, 3.0, 1.0, 1.0, "rayo"), ("a", days[1], "e3", 1.0, 3.0, 1.0, 1.0, "rayo"), ("a", days[3], "e4", 5.0, 0.0, 1.0, 1.0, None)]
    details = spark.createDataFrame(rows, "s string, day date, event_id string, UITI double, UITI_VANO double, DURATION_RAW double, USERS double, cause string")
    got = S.enrich_points(points, attribution, details, ["s", "day"], dimensions=("cause",)).orderBy("rank").collect()
    assert [[(x["label"], x["event_count"], x["contribution_pct"]) for x in r["top_causes"]] for r in got] == [
        [("viento", 2.0, 0.4)], [("rayo", 2.0, 0.7)], [], [("Sin dato", 1.0, 0.5)], [],
    ]
    assert [r["data_quality_flags"] for r in got] == [[], [], ["missing_event_attribution"], ["event_detail_without_metric_contribution"], []]
    assert [r["confidence"] for r in got] == ["high", "high", "low", "low", "medium"]
    assert [len(r["top_events"]) for r in got] == [1, 2, 0, 1, 0]


def test_line_of_a_series_without_points(spark):
    points = critical_points(S.zero_filled_daily(daily(spark, [0.1, 0.2, 9.5, 0.3]), ["s"]), ["s"])
    series = spark.createDataFrame([("a",), ("quiet",)], "s string")
    lines = {r["s"]: r["insight"] for r in insight_lines(points, ["s"], "2024-01-01", "2024-01-04", series).collect()}
    assert lines["a"].startswith("Se detectaron ") and "UITI=9.5 y UITI_VANO=0.0" in lines["a"] and "sin agrupacion dominante" in lines["a"]
    assert lines["quiet"].startswith("No se detectaron puntos criticos entre 2024-01-01 y 2024-01-04. La serie no muestra picos")


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(12.0,), (1.23456,), (123456789.5,), (None,), (-0.5,), (100.0,)], "x double").select(plain_number("x", 4).alias("t")).collect()
    assert [r["t"] for r in rows] == ["12.0", "1.2346", "123456789.5", "0.0", "-0.5", "100.0"]


def test_retrieval_query_of_a_series(spark):
    columns = "s string, rank int, criticality_types array<string>, top_causes array<struct<label:string>>"
    points = spark.createDataFrame([("CIR-1", 2, ["peak"], [("rayo",), ("VIENTO",)]), ("CIR-1", 1, ["outlier", "peak"], [("viento",)]), ("uiti", 1, [], [])], columns)
    got = {r["s"]: r["query_text"] for r in retrieval_queries(points, ["s"]).collect()}
    base = "UITI UITI_VANO impacto confiabilidad calidad del servicio interrupciones duracion fuente usuarios afectados mantenimiento"
    assert got == {"CIR-1": f"{base} CIR-1 outlier peak viento rayo", "uiti": base}


def test_empty_series_flag(spark):
    known = spark.createDataFrame([("a",), ("none",)], "s string")
    flags = {r["s"]: r["flags"] for r in S.quality_flags(daily(spark, [1.0] * 8), ["s"], expected=known).collect()}
    assert flags["none"] == ["empty_time_series"] and "empty_time_series" not in flags["a"]


def test_attribution_reads_its_rows_once(spark):
    frame = daily(spark, [1.0] * 4).select("s", F.lit("x").alias("cause"), *[F.lit(1.0).alias(c) for c in ("event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total")])
    out = S.attribution_items(frame, ["s"], ["cause"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and plan.count("Relation [") == 2


def test_attribution_counts_rows_when_counts_are_zero(spark):
    rows = spark.createDataFrame(
        [("g", "x", 0, 1.0, 0.0, 0.0, 0.0), ("g", "x", 0, 1.0, 0.0, 0.0, 0.0)],
        "k string, cause string, event_count int, uiti_total double, uiti_vano_total double, duration_raw_total double, users_affected_total double",
    )
    assert S.attribution_items(rows, ["k"], ["cause"]).first()["event_count"] == 2.0


def test_trend_takes_earliest_maximum(spark):
    row = S.trend_summary(daily(spark, [1.0, 5.0, 5.0, 2.0]), ["s"]).first()
    assert row["max_date"].day == 2 and row["delta"] == 1.0 and row["nonzero_days"] == 4
