"""Context payloads, map layers and view context (Q1-Q5, Q9, Q10)."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from gridpulse.operators import aggregates as A
from gridpulse.operators.filters import in_window
from gridpulse.operators.reshape import asset_view, filter_index
from gridpulse.plans import maps, payloads
from gridpulse.plans.gold import load_gold, store_gold
from gridpulse.session import ensure_checkpoint_dir
from gridpulse.workload.gold import ASSETS, _asset_points
from gridpulse.workload.registry import ATTRIBUTION, DAILY, FACT, fact, query, r4, text_day


def _daily(t):
    return A.daily_impact(A.event_rollup(fact(t), coordinates=False))


def _field(path: str, kind: str = "string"):
    return F.get_json_object("payload", f"$.{path}").cast(kind)


VIEW_ROWS = "strftime(day, '%Y-%m') = '1997-03' AND municipality = 'ASIA'"


@query(
    "q01_dashboard_context",
    f"WITH {DAILY}, v AS (SELECT circuit, event_family, sum(event_count) AS n, sum(uiti_total) AS u, sum(duration_raw_total) AS d, sum(users_affected_total) AS us FROM daily WHERE {VIEW_ROWS} GROUP BY ALL), "
    "top AS (SELECT * FROM v ORDER BY 2 * u DESC, n DESC, d DESC, circuit, event_family LIMIT 25) "
    "SELECT 'view' AS kind, CAST(sum(n) AS BIGINT) AS event_count, round(sum(u), 4) AS uiti_total, round(sum(d), 2) AS duration_raw_total, round(sum(us), 4) AS users_affected_total, (SELECT count(*) FROM top) AS n_records, "
    "(SELECT circuit FROM top ORDER BY 2 * u DESC, n DESC, d DESC, circuit, event_family LIMIT 1) AS first_circuit, 16 AS hash_chars FROM v",
)
def _(t):
    out = payloads.dashboard_context(A.month_view(_daily(t)), "1997-03", "ASIA", "Todos")
    kpi = "metrics.kpi_summary"
    return out.select(
        _field("kind").alias("kind"), _field(f"{kpi}.event_count", "long").alias("event_count"), _field(f"{kpi}.uiti_total", "double").alias("uiti_total"),
        _field(f"{kpi}.duration_raw_total", "double").alias("duration_raw_total"), _field(f"{kpi}.users_affected_total", "double").alias("users_affected_total"),
        F.size(F.from_json(_field("records"), "array<struct<circuit:string>>")).cast("long").alias("n_records"), _field("records[0].circuit").alias("first_circuit"),
        F.length(_field("context_hash")).alias("hash_chars"),
    )


@query("q01_dashboard_payload")
def _(t):
    view = A.month_view(_daily(t))
    out = payloads.dashboard_context(view, "1997-03", "ASIA", "NATION_2, NATION_7")
    for name in ("get_reliability_summary", "get_compliance_context"):
        out = out.unionByName(payloads.dashboard_context(view, "1997-03", "ASIA", None, name))
    return out


@query(
    "q09_stored_window",
    f"WITH {DAILY} SELECT circuit, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(uiti_total), 4) AS uiti_total FROM daily WHERE day BETWEEN DATE '1997-02-10' AND DATE '1997-04-20' GROUP BY circuit",
)
def _(t):
    """A window of the stored daily table: only the folders of its months are read."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    store_gold({"impact_daily": _daily(t)}, folder)
    daily = load_gold(t.spark, folder, "impact_daily")["impact_daily"]
    rows = in_window(daily, date(1997, 2, 10), date(1997, 4, 20))
    return rows.groupBy("circuit").agg(F.sum("event_count").cast("long").alias("event_count"), F.round(F.sum("uiti_total"), 4).alias("uiti_total"))


@query(
    "q02_event_context",
    f"WITH {FACT}, e AS (SELECT event_id, circuit, cause, equipment, span_impact, event_impact, duration, day FROM fact WHERE event_id = 4242 ORDER BY day, span_impact DESC, equipment LIMIT 1) "
    "SELECT '4242' AS event_id, circuit, cause, equipment, round(span_impact, 4) AS uiti_vano, round(event_impact, 4) AS uiti, duration AS duration_raw FROM e",
)
def _(t):
    rows = fact(t).withColumns({"UITI": F.col("event_impact"), "UITI_VANO": F.col("span_impact"), "DURATION_RAW": F.col("duration")})
    out = payloads.event_context(rows, "4242")
    return out.select(
        *[_field(c).alias(c) for c in ("event_id", "circuit", "cause", "equipment")], F.round(_field("metrics.UITI_VANO", "double"), 4).alias("uiti_vano"),
        F.round(_field("metrics.UITI", "double"), 4).alias("uiti"), _field("metrics.DURATION_RAW", "double").alias("duration_raw"),
    )


@query(
    "q03_asset_context",
    f"WITH {ASSETS} SELECT asset_family || ' part-77 asociado al circuito ' || circuit || ' en ' || municipality || '.' AS text, round(latitude, 4) AS latitude FROM assets WHERE display_label = 'part-77'",
)
def _(t):
    points = _asset_points(t)
    assets = asset_view(points, points.limit(0).withColumns({"latitude_end": F.lit(0.0), "longitude_end": F.lit(0.0)}))
    wanted = assets.where("display_label = 'part-77'").select("asset_id").first()[0]
    out = payloads.asset_context(assets, wanted)
    return out.select(_field("summary.text").alias("text"), F.round(_field("latitude", "double"), 4).alias("latitude"))


@query(
    "q04_circuit_history",
    f"WITH {DAILY}, h AS (SELECT day, municipality, sum(event_count) AS n, sum(uiti_total) AS u FROM daily WHERE circuit = 'NATION_3' AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL) "
    "SELECT 'Historial del circuito NATION_3 entre 1996-01-01 y 1998-12-31. Eventos: ' || CAST(sum(n) AS BIGINT) || '.' AS text, round(sum(u), 4) AS uiti_total, CAST(max(day) AS VARCHAR) AS newest, least(count(*), 50) AS n_records FROM h",
)
def _(t):
    out = payloads.circuit_history_context(A.circuit_history(_daily(t)), "NATION_3", "1996-01-01", "1998-12-31")
    return out.select(
        _field("summary.text").alias("text"), _field("metrics.uiti_total", "double").alias("uiti_total"), _field("records[0].day").alias("newest"),
        F.size(F.from_json(_field("records"), "array<struct<day:string>>")).cast("long").alias("n_records"),
    )


@query(
    "q05_timeseries_context",
    f"WITH {ATTRIBUTION}, f AS (SELECT * FROM attribution WHERE circuit = 'NATION_5' AND day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') "
    "SELECT count(DISTINCT day) AS critical_date_count, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(uiti_total), 4) AS uiti_total, CAST(min(day) AS VARCHAR) AS first_day, least(count(*), 75) AS n_records FROM f",
)
def _(t):
    out = payloads.timeseries_context(A.daily_attribution(fact(t)), "NATION_5", "1997-01-01", "1997-12-31", None)
    return out.select(
        _field("metrics.critical_date_count", "long").alias("critical_date_count"), _field("metrics.event_count", "long").alias("event_count"),
        _field("metrics.uiti_total", "double").alias("uiti_total"), _field("records[0].day").alias("first_day"),
        F.size(F.from_json(_field("records"), "array<struct<day:string>>")).cast("long").alias("n_records"),
    )


def _layers(t, circuits=None, day=None):
    events = fact(t).withColumn("period", F.date_format("day", "yyyy-MM"))
    points = events.groupBy("equipment", "circuit", "municipality").agg(F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"))
    assets = points.withColumn("asset_family", F.when(F.col("equipment") == "Brand#1", "Supports").otherwise("Switches"))
    segments = points.withColumns({"latitude_end": F.col("latitude") + 0.01, "longitude_end": F.col("longitude") + 0.01})
    return maps.map_layers(assets, segments, events, "1997-03", "ASIA", circuits, day)


@query("q09_map_events", f"WITH {FACT} SELECT event_id, span_id, profile_id, circuit FROM fact WHERE strftime(day, '%Y-%m') = '1997-03' AND municipality = 'ASIA' AND day(day) = 12")
def _(t):
    return _layers(t, day=12)["events"].select("event_id", "span_id", "profile_id", "circuit")


@query("q09_map_assets", f"WITH {FACT} SELECT equipment, circuit, round(max(latitude), 4) AS latitude FROM fact WHERE municipality = 'ASIA' AND circuit IN ('NATION_2', 'NATION_7') AND equipment <> 'Brand#1' GROUP BY ALL")
def _(t):
    return _layers(t, ["NATION_2", "NATION_7"])["assets"].select("equipment", "circuit", *r4("latitude"))


@query("q09_map_days", f"WITH {FACT} SELECT day(day) AS map_day, count(*) AS events FROM fact WHERE strftime(day, '%Y-%m') = '1997-03' AND municipality = 'ASIA' GROUP BY 1")
def _(t):
    return _layers(t)["days"]


@query("q09_filter_metadata", f"WITH {FACT} SELECT DISTINCT municipality, strftime(day, '%Y-%m') AS period FROM fact WHERE strftime(day, '%Y-%m') = '1997-03' AND municipality IS NOT NULL")
def _(t):
    index = filter_index([fact(t).select(F.date_format("day", "yyyy-MM").alias("period"), "municipality", "circuit")])
    return maps.filter_metadata(index, "1997-03")["municipalities"].withColumn("period", F.lit("1997-03"))


@query(
    "q10_view_context",
    f"WITH {ATTRIBUTION}, v AS (SELECT * FROM attribution WHERE {VIEW_ROWS}), l AS (SELECT 'circuit' AS dimension, circuit AS label, event_count, uiti_total, duration_raw_total FROM v UNION ALL SELECT 'event_family', event_family, event_count, uiti_total, duration_raw_total FROM v UNION ALL SELECT 'cause', cause, event_count, uiti_total, duration_raw_total FROM v), "
    "g AS (SELECT dimension, label, sum(event_count) AS n, 2 * sum(uiti_total) AS s, sum(duration_raw_total) AS d FROM l GROUP BY ALL) SELECT dimension, label, CAST(n AS DOUBLE) AS event_count, round(s, 4) AS impact_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY s DESC, n DESC, d DESC, label) AS rank FROM g) WHERE rank <= 5",
)
def _(t):
    out = payloads.view_context(A.daily_attribution(fact(t)), "1997-03", "ASIA")["top"]
    return out.select("dimension", "label", "event_count", *r4("impact_score"), "rank")


@query(
    "q10_view_kpi",
    f"WITH {ATTRIBUTION} SELECT CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(uiti_total), 4) AS uiti_total, round(sum(users_affected_total), 4) AS users_affected_total FROM attribution WHERE {VIEW_ROWS}",
)
def _(t):
    return payloads.view_context(A.daily_attribution(fact(t)), "1997-03", "ASIA")["kpi"].select("event_count", *r4("uiti_total", "users_affected_total"))
