"""Roll-ups, unions and option lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions.metrics import METRIC_KEYS, map_to_columns
from gridpulse.operators import aggregates as A
from gridpulse.operators import reshape as R
from gridpulse.operators import series as S
from gridpulse.workload.registry import ATTRIBUTION, DAILY, FACT, SILVER, STREAM, fact, query, r4, sql_r4, stream, stream_daily, text_day

SUMS = ("uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total")


@query(
    "a01_event_rollup",
    f"WITH {SILVER} SELECT event_id, CAST(day AS VARCHAR) AS day, circuit, municipality, cause, event_family, "
    f"{sql_r4('uiti_total', 'uiti_vano_total', 'uiti_event_total', 'duration_raw', 'users_affected')}, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, "
    "CAST(transformer_count AS DOUBLE) AS transformer_count, fact_row_count, equipment, equipment_type, element_type FROM silver_events",
)
def _(t):
    return A.event_rollup(fact(t)).select(
        "event_id", text_day(), "circuit", "municipality", "cause", "event_family",
        *r4("uiti_total", "uiti_vano_total", "uiti_event_total", "duration_raw", "users_affected"),
        F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
        "transformer_count", "fact_row_count", "equipment", "equipment_type", "element_type",
    )


@query(
    "a02_daily_impact",
    f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, circuit, municipality, event_family, {sql_r4(*SUMS)}, event_count, "
    "CAST(first_event_ts AS VARCHAR) AS first_event_ts, CAST(last_event_ts AS VARCHAR) AS last_event_ts, "
    "round(uiti_total, 4) AS metric_uiti, CAST(event_count AS DOUBLE) AS metric_event_count FROM daily",
)
def _(t):
    daily = A.daily_impact(A.event_rollup(fact(t), coordinates=False))
    return daily.select(
        text_day(), "circuit", "municipality", "event_family", *r4(*SUMS), "event_count",
        F.date_format("first_event_ts", "yyyy-MM-dd HH:mm:ss").alias("first_event_ts"),
        F.date_format("last_event_ts", "yyyy-MM-dd HH:mm:ss").alias("last_event_ts"),
        F.round(F.element_at("metrics", F.lit("UITI")), 4).alias("metric_uiti"),
        F.element_at("metrics", F.lit("EVENT_COUNT")).alias("metric_event_count"),
    )


@query(
    "a03_circuit_summary",
    f"WITH {SILVER} SELECT circuit, municipality, event_family, {sql_r4('sum(uiti_total)').replace('AS sum(uiti_total)', 'AS uiti_total')}, "
    "count(DISTINCT event_id) AS event_count, round(avg(duration_raw), 4) AS duration_raw_avg, round(sum(duration_raw), 4) AS duration_raw_total, "
    "round(sum(users_affected), 4) AS users_affected_total FROM silver_events GROUP BY circuit, municipality, event_family",
)
def _(t):
    return A.circuit_summary(A.event_rollup(fact(t), coordinates=False)).select(
        "circuit", "municipality", "event_family", *r4("uiti_total"), "event_count",
        *r4("duration_raw_avg", "duration_raw_total", "users_affected_total"),
    )


@query(
    "a04_daily_attribution",
    f"WITH {ATTRIBUTION} SELECT CAST(day AS VARCHAR) AS day, circuit, municipality, cause, event_family, equipment, equipment_type, event_count, "
    f"{sql_r4(*SUMS)} FROM attribution",
)
def _(t):
    return A.daily_attribution(fact(t)).select(
        text_day(), "circuit", "municipality", "cause", "event_family", "equipment", "equipment_type", "event_count", *r4(*SUMS)
    )


def hourly_wide(t):
    """Largest value and k per user, day and hour as ``temp_<hour>`` and ``wind_<hour>`` text columns."""
    base = stream(t).withColumn("hour", F.hour("ts"))
    agg = []
    for h in range(24):
        agg.append(F.max(F.when(F.col("hour") == h, F.col("value"))).cast("string").alias(f"temp_{h}"))
        agg.append(F.max(F.when(F.col("hour") == h, F.col("k"))).cast("string").alias(f"wind_{h}"))
    return base.groupBy("user_id", "day").agg(*agg)


HOURLY = STREAM + ", hourly AS (SELECT user_id, day, " + ", ".join(
    f"max(value) FILTER (hour(ts) = {h}) AS temp_{h}, max(k) FILTER (hour(ts) = {h}) AS wind_{h}" for h in range(24)
) + " FROM stream GROUP BY user_id, day)"
HOUR_COLUMNS = [f"{v}_{h}" for h in range(24) for v in ("temp", "wind")]


@query(
    "a05_environment_daily",
    f"WITH {HOURLY} SELECT CAST(day AS VARCHAR) AS day, user_id % 10 AS municipality, "
    + ", ".join(f"round(avg({c}), 6) AS {c}_avg" for c in HOUR_COLUMNS)
    + " FROM hourly GROUP BY day, user_id % 10",
)
def _(t):
    wide = hourly_wide(t).withColumn("municipality", F.pmod("user_id", F.lit(10)))
    out = A.environment_daily(wide, ["day", "municipality"], HOUR_COLUMNS)
    return out.select(text_day(), "municipality", *[F.round(f"{c}_avg", 6).alias(f"{c}_avg") for c in HOUR_COLUMNS])


@query(
    "a06_window_totals",
    f"WITH {DAILY} SELECT round(coalesce(sum(uiti_total), 0), 4) AS UITI, round(coalesce(sum(uiti_vano_total), 0), 4) AS UITI_VANO, "
    "CAST(coalesce(sum(event_count), 0) AS DOUBLE) AS EVENT_COUNT, round(coalesce(sum(users_affected_total), 0), 4) AS USERS, "
    "round(coalesce(sum(duration_raw_total), 0), 4) AS DURATION_RAW FROM daily WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
)
def _(t):
    from gridpulse.functions.metrics import METRIC_TOTALS

    daily = A.daily_impact(A.event_rollup(fact(t), coordinates=False)).where("day between date'1996-01-01' and date'1996-12-31'")
    return A.window_totals(daily, METRIC_TOTALS).select(*r4(*METRIC_KEYS))


@query(
    "a07_zero_filled_daily",
    f"WITH {STREAM} SELECT circuit, CAST(day AS VARCHAR) AS day, {sql_r4('UITI', 'UITI_VANO', 'EVENT_COUNT', 'USERS', 'DURATION_RAW')} FROM series",
)
def _(t):
    return S.zero_filled_daily(stream_daily(t), ["circuit"]).select("circuit", text_day(), *r4(*METRIC_KEYS))


@query(
    "a07_map_zero_filled",
    f"WITH {DAILY}, d AS (SELECT day, sum(uiti_total) AS u, sum(event_count) AS n FROM daily GROUP BY day), "
    "b AS (SELECT min(day) AS a, max(day) AS z FROM d), c AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b) "
    "SELECT CAST(c.day AS VARCHAR) AS day, round(coalesce(u, 0), 4) AS UITI, CAST(coalesce(n, 0) AS DOUBLE) AS EVENT_COUNT FROM c LEFT JOIN d USING (day)",
)
def _(t):
    daily = A.daily_impact(A.event_rollup(fact(t), coordinates=False)).select("day", "metrics")
    flat = map_to_columns(daily).withColumn("scope", F.lit("all"))
    return S.zero_filled_daily(flat, ["scope"]).select(text_day(), *r4("UITI", "EVENT_COUNT"))


@query(
    "a08_two_level_daily",
    f"WITH {FACT}, e AS (SELECT day, event_id, max(event_impact) AS e, sum(span_impact) AS s, sum(users) AS u, max(duration) AS d FROM fact GROUP BY ALL) "
    "SELECT CAST(day AS VARCHAR) AS day, round(sum(e), 4) AS UITI, round(sum(s), 4) AS UITI_VANO, count(*) AS EVENT_COUNT, round(sum(u), 4) AS USERS, "
    "round(sum(d), 4) AS DURATION_RAW FROM e GROUP BY day",
)
def _(t):
    return A.two_level_daily(fact(t)).select(text_day(), *r4("UITI", "UITI_VANO", "USERS", "DURATION_RAW"), "EVENT_COUNT")


@query("a09_option_list", "SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> ''")
def _(t):
    return A.option_list(t.part, "p_type")


@query("a09_dependent_options", f"WITH {FACT} SELECT DISTINCT municipality, circuit, cause FROM fact WHERE municipality IS NOT NULL AND circuit IS NOT NULL AND cause IS NOT NULL")
def _(t):
    return A.dependent_options(fact(t), ["municipality", "circuit", "cause"])


@query("a09_date_bounds", f"WITH {FACT} SELECT CAST(min(day) AS VARCHAR) AS min_date, CAST(max(day) AS VARCHAR) AS max_date, count(DISTINCT circuit) AS circuits, count(DISTINCT municipality) AS municipalities FROM fact")
def _(t):
    from gridpulse.plans.interpret import summary_metadata

    return summary_metadata(fact(t)).select(
        F.col("min_date").cast("string").alias("min_date"), F.col("max_date").cast("string").alias("max_date"), "circuits", "municipalities"
    )


def _items_sql(score: str) -> str:
    dims = " UNION ALL ".join(
        f"SELECT municipality, '{d}' AS dimension, coalesce(nullif(trim({d}), ''), 'Sin dato') AS label, event_count, uiti_total, uiti_vano_total, duration_raw_total, users_affected_total FROM attribution"
        for d in ("cause", "event_family", "equipment")
    )
    return (
        f"WITH {ATTRIBUTION}, tall AS ({dims}), g AS (SELECT municipality, dimension, label, CAST(sum(event_count) AS DOUBLE) AS event_count, "
        "sum(uiti_total) AS uiti_total, sum(uiti_vano_total) AS uiti_vano_total, sum(duration_raw_total) AS duration_raw_total, "
        "sum(users_affected_total) AS users_affected_total FROM tall GROUP BY ALL), "
        f"s AS (SELECT *, {score} AS impact_score FROM g), "
        "r AS (SELECT *, sum(impact_score) OVER (PARTITION BY municipality, dimension) AS total, row_number() OVER (PARTITION BY municipality, dimension "
        "ORDER BY impact_score DESC, event_count DESC, duration_raw_total DESC, label) AS rank FROM s) "
        "SELECT municipality, dimension, label, rank, event_count, round(impact_score, 4) AS impact_score, round(users_affected_total, 4) AS users_affected_total, "
        "CASE WHEN total > 0 THEN round(impact_score / total, 4) END AS contribution_pct FROM r WHERE rank <= 5"
    )


def _items(t, score=None):
    items = S.attribution_items(A.daily_attribution(fact(t)), ["municipality"], ["cause", "event_family", "equipment"], score=score)
    return items.select(
        "municipality", "dimension", "label", "rank", "event_count", *r4("impact_score", "users_affected_total"), "contribution_pct"
    )


@query("a10_top_attribution", _items_sql("uiti_total"))
def _(t):
    return _items(t)


@query("a11_top_attribution_both", _items_sql("uiti_total + uiti_vano_total"))
def _(t):
    return _items(t, F.col("uiti_total") + F.col("uiti_vano_total"))


OPTIONS_SQL = f"WITH {FACT}, o AS (SELECT event_id, min(day) AS day, min(circuit) AS circuit, min(municipality) AS municipality, min(cause) AS cause, " \
    "max(event_impact) AS UITI, sum(span_impact) AS UITI_VANO, max(duration) AS DURATION_RAW, sum(users) AS USERS, count(*) AS detail_count FROM fact GROUP BY event_id) " \
    "SELECT event_id, CAST(day AS VARCHAR) AS day, circuit, municipality, cause, round(UITI, 4) AS UITI, round(UITI_VANO, 4) AS UITI_VANO, round(DURATION_RAW, 4) AS DURATION_RAW, " \
    "round(USERS, 4) AS USERS, detail_count FROM o"


def _options(frame):
    return frame.select(
        "event_id", text_day(), "circuit", "municipality", "cause", *r4("UITI", "UITI_VANO", "DURATION_RAW", "USERS"), "detail_count"
    )


@query("a12_event_options", OPTIONS_SQL)
def _(t):
    return _options(A.event_options(fact(t)))


@query("l01_ordered_event_options", OPTIONS_SQL + " ORDER BY o.day, o.UITI_VANO DESC, o.DURATION_RAW DESC, event_id LIMIT 500")
def _(t):
    return _options(A.ordered_event_options(A.event_options(fact(t)), 500))


@query(
    "a13_trend_summary",
    f"WITH {STREAM} SELECT circuit, round(arg_min(UITI, day), 4) AS first_value, round(arg_max(UITI, day), 4) AS last_value, "
    "round(arg_max(UITI, day) - arg_min(UITI, day), 4) AS delta, CAST(min(day) FILTER (UITI = mx) AS VARCHAR) AS max_date, round(max(UITI), 4) AS max_value, "
    "count(*) FILTER (UITI > 0) AS nonzero_days FROM (SELECT *, max(UITI) OVER (PARTITION BY circuit) AS mx FROM series) GROUP BY circuit",
)
def _(t):
    out = S.trend_summary(S.zero_filled_daily(stream_daily(t), ["circuit"]), ["circuit"])
    return out.withColumn("max_date", F.col("max_date").cast("string"))


@query(
    "a14_month_view",
    f"WITH {DAILY} SELECT strftime(day, '%Y-%m') AS period, municipality, circuit, event_family, round(sum(uiti_total), 4) AS uiti_total, CAST(sum(event_count) AS BIGINT) AS event_count, "
    "round(sum(duration_raw_total), 4) AS duration_raw_total, round(sum(users_affected_total), 4) AS users_affected_total FROM daily GROUP BY ALL",
)
def _(t):
    view = A.month_view(A.daily_impact(A.event_rollup(fact(t), coordinates=False)))
    return view.select("period", "municipality", "circuit", "event_family", *r4("uiti_total", "duration_raw_total", "users_affected_total"), "event_count")


@query(
    "a14_circuit_history",
    f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, municipality, circuit, round(sum(uiti_total), 4) AS uiti_total, CAST(sum(event_count) AS BIGINT) AS event_count, "
    "round(sum(users_affected_total), 4) AS users_affected_total FROM daily GROUP BY day, municipality, circuit",
)
def _(t):
    hist = A.circuit_history(A.daily_impact(A.event_rollup(fact(t), coordinates=False)))
    return hist.select(text_day(), "municipality", "circuit", *r4("uiti_total", "users_affected_total"), "event_count")


@query(
    "a15_daily_signals",
    f"WITH {HOURLY}, s AS (SELECT day, " + ", ".join(f"sum({c}) AS {c}" for c in HOUR_COLUMNS) + " FROM hourly GROUP BY day) "
    "SELECT CAST(day AS VARCHAR) AS day, signal, round(total, 2) AS total FROM (UNPIVOT s ON " + ", ".join(HOUR_COLUMNS) + " INTO NAME signal VALUE total)",
)
def _(t):
    return S.daily_signals(hourly_wide(t), ["day"], HOUR_COLUMNS).select(text_day(), "signal", "total")


@query(
    "a15_suffix_signals",
    f"WITH {HOURLY}, l AS (UNPIVOT hourly ON {', '.join(HOUR_COLUMNS)} INTO NAME n VALUE v) SELECT CAST(day AS VARCHAR) AS day, "
    "round(sum(v) FILTER (n LIKE '%\\_1' ESCAPE '\\'), 2) AS \"1_sum\", round(max(v) FILTER (n LIKE '%\\_2' ESCAPE '\\'), 2) AS \"2_max\", "
    "round(avg(v) FILTER (n LIKE '%\\_3' ESCAPE '\\'), 6) AS \"3_mean\" FROM l GROUP BY day",
)
def _(t):
    out = A.signals_by_suffix(hourly_wide(t), ["day"], {"_1": "sum", "_2": "max", "_3": "mean"})
    return out.select(text_day(), *[F.round(c, d).alias(c) for c, d in (("1_sum", 2), ("2_max", 2), ("3_mean", 6))])


@query(
    "a16_monthly_trend",
    f"WITH {DAILY} SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month, event_family, round(sum(uiti_total), 4) AS uiti_total FROM daily GROUP BY ALL",
)
def _(t):
    out = A.monthly_trend(A.daily_impact(A.event_rollup(fact(t), coordinates=False)), "uiti_total", ["event_family"])
    return out.select(F.col("month").cast("string").alias("month"), "event_family", *r4("uiti_total"))


@query("a16_top_circuits", f"WITH {DAILY} SELECT circuit, round(sum(uiti_total), 4) AS uiti_total FROM daily GROUP BY circuit ORDER BY sum(uiti_total) DESC, circuit LIMIT 10")
def _(t):
    return A.top_group(A.daily_impact(A.event_rollup(fact(t), coordinates=False)), "circuit", "uiti_total").select("circuit", *r4("uiti_total"))


def _values(rows) -> str:
    """Rule rows as SQL, numbered by priority."""
    text = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'"
    return ", ".join(f"({i}, {', '.join(map(text, row))})" for i, row in enumerate(rows))


USAGE = (
    "u AS (SELECT l_returnflag || '_' || l_linestatus AS workspace_id, "
    "coalesce(['APPS', 'SQL', 'JOBS', 'VECTOR_SEARCH', 'MODEL_SERVING'][l_linenumber % 7 + 1], 'OTHER') AS billing_origin_product, "
    "coalesce(['PREMIUM_SERVERLESS_SQL', 'AUTOMATED_SERVERLESS', 'DATABRICKS_STORAGE_UNIT', 'REALTIME_INFERENCE'][l_linenumber % 5 + 1], 'PLAIN') AS sku_name, "
    "coalesce(['DBU', 'DSU'][l_linenumber % 3 + 1], 'TOKEN') AS usage_unit, l_quantity FROM lineitem)"
)


@query(
    "a20_priced_usage",
    f"WITH {USAGE}, s AS (SELECT workspace_id, billing_origin_product, sku_name, usage_unit, sum(l_quantity) AS usage_quantity FROM u GROUP BY ALL), "
    f"labels(place, product, sku, label) AS (VALUES {_values(row[:3] for row in A.COMPONENTS)}), "
    f"prices(place, unit, sku, usd) AS (VALUES {_values(A.PRICES)}), "
    f"notes(counted, priced, note) AS (VALUES (false, false, '{A.NOTE_OTHER_UNIT}'), (false, true, '{A.NOTE_OTHER_PRICED}'), (true, false, '{A.NOTE_UNMAPPED}'), (true, true, '{A.NOTE_PRICED}')), "
    "rated AS (SELECT s.*, (SELECT arg_min(label, place) FROM labels l WHERE upper(billing_origin_product) LIKE l.product OR upper(sku_name) LIKE l.sku) AS label, "
    "(SELECT arg_min(usd, place) FROM prices p WHERE upper(sku_name) LIKE p.sku AND coalesce(p.unit, usage_unit) = usage_unit) AS usd_per_unit FROM s WHERE usage_quantity <> 0) "
    "SELECT workspace_id, billing_origin_product, sku_name, usage_unit, usage_quantity, coalesce(label, billing_origin_product, 'Other') AS component, usd_per_unit, "
    "round(usage_quantity * usd_per_unit, 4) AS estimated_usd, note AS pricing_note FROM rated JOIN notes ON counted = (usage_unit IN ('DBU', 'DSU')) AND priced = (usd_per_unit IS NOT NULL)",
)
def _(t):
    return A.priced_usage(_usage(t), ["workspace_id", "billing_origin_product", "sku_name", "usage_unit"])


def _usage(t):
    def pick(modulus: int, names: list[str], other: str):
        out = None
        for i, name in enumerate(names):
            test = F.col("l_linenumber") % modulus == i
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise(other)

    return t.lineitem.select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("workspace_id"),
        pick(7, ["APPS", "SQL", "JOBS", "VECTOR_SEARCH", "MODEL_SERVING"], "OTHER").alias("billing_origin_product"),
        pick(5, ["PREMIUM_SERVERLESS_SQL", "AUTOMATED_SERVERLESS", "DATABRICKS_STORAGE_UNIT", "REALTIME_INFERENCE"], "PLAIN").alias("sku_name"),
        pick(3, ["DBU", "DSU"], "TOKEN").alias("usage_unit"),
        F.col("l_quantity").alias("usage_quantity"),
    )


from gridpulse.workload.registry import SQL as _SQL  # noqa: E402


@query(
    "a20_pricing_subtotals",
    "SELECT usage_unit, pricing_note, sum(usage_quantity) AS usage_quantity, round(sum(coalesce(estimated_usd, 0)), 4) AS estimated_usd FROM ("
    + _SQL["a20_priced_usage"] + ") GROUP BY usage_unit, pricing_note",
)
def _(t):
    return A.pricing_subtotals(A.priced_usage(_usage(t), ["workspace_id", "billing_origin_product", "sku_name", "usage_unit"]))


@query(
    "a24_kind_counts",
    f"WITH {FACT} SELECT element_type, equipment_type, event_family, count(*) AS n FROM fact GROUP BY ALL",
)
def _(t):
    return fact(t).groupBy("element_type", "equipment_type", "event_family").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a25_combination_counts",
    f"WITH {FACT} SELECT circuit, equipment_type, element_type, count(*) AS value FROM fact WHERE circuit IS NOT NULL AND equipment_type IS NOT NULL AND element_type IS NOT NULL GROUP BY ALL",
)
def _(t):
    return A.combination_counts(fact(t), ["circuit", "equipment_type", "element_type"])


@query(
    "a26_map_extent",
    f"WITH {FACT} SELECT 0 AS layer, round(avg(latitude), 4) AS center_lat, round(avg(longitude), 4) AS center_lon, round(min(latitude), 4) AS min_lat, "
    "round(max(latitude), 4) AS max_lat, round(min(longitude), 4) AS min_lon, round(max(longitude), 4) AS max_lon FROM fact",
)
def _(t):
    names = ("center_lat", "center_lon", "min_lat", "max_lat", "min_lon", "max_lon")
    return A.map_extent([fact(t).select("latitude", "longitude")]).select("layer", *r4(*names))


@query(
    "a33_label_weights",
    f"WITH {ATTRIBUTION}, w AS (SELECT municipality, cause, sum(greatest(CASE WHEN uiti_total + uiti_vano_total > 0 THEN uiti_total + uiti_vano_total ELSE event_count END, 0)) AS weight "
    "FROM attribution WHERE length(trim(cause)) > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY weight DESC, cause DESC) AS rank FROM w) "
    "SELECT municipality, cause, round(weight, 4) AS weight, rank FROM r WHERE rank <= 5",
)
def _(t):
    return A.label_weights(A.daily_attribution(fact(t)), ["municipality"], "cause").withColumn("weight", F.round("weight", 4))


@query(
    "a34_strike_summary",
    f"WITH {STREAM}, n AS (SELECT strftime(day, '%Y-%m') AS period, user_id % 10 AS municipality, user_id, count(*) AS c FROM stream GROUP BY ALL), "
    "m AS (SELECT period, municipality, user_id FROM n QUALIFY row_number() OVER (PARTITION BY period, municipality ORDER BY c DESC, user_id) = 1) "
    "SELECT s.*, m.user_id AS top_name FROM (SELECT strftime(day, '%Y-%m') AS period, user_id % 10 AS municipality, round(avg(value), 3) AS mean_value, min(value) AS min_value, "
    "max(value) AS max_value, round(stddev_samp(value), 3) AS std_value, count(*) AS strikes, count(*) FILTER (circuit = 'click') AS n_click, "
    "count(*) FILTER (circuit = 'error') AS n_error, round(quantile_cont(value, 0.5), 4) AS median_value FROM stream GROUP BY ALL) s JOIN m USING (period, municipality)",
)
def _(t):
    rows = stream(t).select(
        F.date_format("day", "yyyy-MM").alias("period"), F.pmod("user_id", F.lit(10)).alias("municipality"), "value", "circuit", "user_id"
    )
    out = A.strike_summary(rows, ["period", "municipality"], "value", "circuit", ["click", "error"], "user_id")
    return out.select(
        "period", "municipality", F.round("mean_value", 3).alias("mean_value"), "min_value", "max_value", F.round("std_value", 3).alias("std_value"),
        "strikes", "n_click", "n_error", F.round("median_value", 4).alias("median_value"), "top_name",
    )


# ---------------------------------------------------------------- set operations


def _event_points(t):
    return A.event_rollup(fact(t)).select("event_id", "circuit", "municipality", F.date_format("day", "yyyy-MM").alias("period"), "latitude", "longitude")


def _asset_points(t):
    return t.part.select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("display_label"),
        F.col("p_brand").alias("asset_family"),
        F.col("p_type").alias("circuit"),
        F.col("p_name").alias("municipality"),
        F.lit("1998-01").alias("period"),
        (F.lit(4.0) + F.floor(F.col("p_partkey") / 100) * 0.01).alias("latitude"),
        (F.lit(-76.0) + F.pmod("p_partkey", F.lit(100)) * 0.01).alias("longitude"),
        F.lit("point").alias("geometry_kind"),
    )


ASSETS = """assets AS (SELECT 'part-' || p_partkey AS display_label, p_brand AS asset_family, p_type AS circuit, p_name AS municipality, '1998-01' AS period,
 4.0::DOUBLE + floor(p_partkey / 100.0::DOUBLE) * 0.01::DOUBLE AS latitude, -76.0::DOUBLE + (p_partkey % 100) * 0.01::DOUBLE AS longitude FROM part)"""


@query(
    "u01_point_layer",
    f"WITH {SILVER}, {ASSETS} SELECT 'event' AS point_kind, CAST(event_id AS VARCHAR) AS event_id, NULL AS display_label, circuit, municipality, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM silver_events "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL UNION ALL SELECT 'asset', NULL, display_label, circuit, municipality, round(latitude, 6), round(longitude, 6) FROM assets",
)
def _(t):
    return R.point_layer(_event_points(t), _asset_points(t)).select(
        "point_kind", F.col("event_id").cast("string").alias("event_id"), "display_label", "circuit", "municipality", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )


@query(
    "u02_asset_view",
    f"WITH {ASSETS}, v AS (SELECT asset_family, display_label, circuit, municipality, p.latitude::VARCHAR AS la, p.longitude::VARCHAR AS lo FROM assets p) "
    "SELECT 'point' AS geometry_kind, display_label, circuit, municipality FROM v UNION ALL SELECT 'line', display_label, circuit, municipality FROM v",
)
def _(t):
    points = _asset_points(t)
    lines = points.withColumns({"latitude_end": F.col("latitude") + 0.01, "longitude_end": F.col("longitude") + 0.01, "geometry_kind": F.lit("line")})
    return R.asset_view(points, lines).select("geometry_kind", "display_label", "circuit", "municipality")


@query(
    "u03_criteria_union",
    "SELECT 'interruptor' AS criteria_group, p_partkey AS key, p_retailprice AS value, p_brand AS brand FROM part "
    "UNION ALL SELECT 'transformador', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'usuario', c_custkey, c_acctbal, NULL FROM customer",
)
def _(t):
    return R.criteria_union(
        {
            "interruptor": t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"), F.col("p_brand").alias("brand")),
            "transformador": t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value")),
            "usuario": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")),
        }
    ).select("criteria_group", "key", "value", "brand")


@query(
    "u04_filter_index",
    f"WITH {SILVER}, {ASSETS} SELECT DISTINCT strftime(day, '%Y-%m') AS period, municipality, circuit FROM silver_events WHERE day IS NOT NULL UNION SELECT DISTINCT period, municipality, circuit FROM assets",
)
def _(t):
    layer = fact(t).select(F.date_format("day", "yyyy-MM").alias("period"), "municipality", "circuit")
    return R.filter_index([layer, _asset_points(t)])


@query(
    "u05_circuit_names",
    "SELECT 0 AS position, 'Todos' AS name UNION ALL SELECT 1, name FROM (SELECT trim(n_name) AS name FROM nation UNION SELECT trim(r_name) FROM region UNION SELECT trim(p_brand) FROM part UNION SELECT trim(s_name) FROM supplier) WHERE name <> ''",
)
def _(t):
    return R.circuit_names([(t.nation, "n_name"), (t.region, "r_name"), (t.part, "p_brand"), (t.supplier, "s_name")])


WIDE = HOURLY


@query(
    "u07_wide_to_long",
    f"WITH {HOURLY} " + " UNION ALL ".join(f"SELECT user_id, CAST(day AS VARCHAR) AS day, {h} AS \"offset\", temp_{h} AS temp, wind_{h} AS wind FROM hourly" for h in range(24)),
)
def _(t):
    long = R.wide_to_long(hourly_wide(t), ["user_id", "day"], ["temp", "wind"], range(24))
    return long.select("user_id", text_day(), "offset", F.col("temp").cast("double").alias("temp"), F.col("wind").cast("double").alias("wind"))


@query(
    "u07_long_to_wide",
    f"WITH {HOURLY} SELECT user_id, CAST(day AS VARCHAR) AS day, {', '.join(HOUR_COLUMNS)} FROM hourly",
)
def _(t):
    long = (
        stream(t).groupBy("user_id", "day", F.hour("ts").alias("offset")).agg(F.max("value").alias("temp"), F.max("k").alias("wind"))
    )
    wide = R.long_to_wide(long, ["user_id", "day"], ["temp", "wind"], range(24))
    return wide.select("user_id", text_day(), *HOUR_COLUMNS)


@query("u08_events_by_day", f"WITH {FACT} SELECT day(day) AS map_day, count(*) AS n, round(sum(span_impact), 4) AS impact FROM fact GROUP BY day(day)")
def _(t):
    rows = R.events_by_day(fact(t).select("day", "span_impact"))
    return rows.groupBy("map_day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("span_impact"), 4).alias("impact"))


@query(
    "l02_bounded_records",
    f"WITH {ATTRIBUTION} SELECT CAST(day AS VARCHAR) AS day, circuit, cause, equipment, equipment_type, event_family, round(uiti_total, 4) AS uiti_total FROM attribution "
    "ORDER BY uiti_total DESC, attribution.day, circuit, cause, equipment, equipment_type, event_family LIMIT 75",
)
def _(t):
    rows = A.daily_attribution(fact(t)).orderBy(F.desc("uiti_total"), "day", "circuit", "cause", "equipment", "equipment_type", "event_family").limit(75)
    return rows.select(text_day(), "circuit", "cause", "equipment", "equipment_type", "event_family", *r4("uiti_total"))


@query(
    "l03_stable_sample",
    f"WITH {FACT} SELECT event_id, span_id, profile_id, transformer_count, span_impact FROM fact "
    "ORDER BY md5(concat_ws('|', event_id, span_id, profile_id, transformer_count)), event_id, span_id, profile_id, transformer_count LIMIT 50000",
)
def _(t):
    rows = fact(t).select("event_id", "span_id", "profile_id", "transformer_count", "span_impact")
    return R.hash_ordered_sample(rows, ["event_id", "span_id", "profile_id", "transformer_count"], 50_000)


@query(
    "l04_top_events_per_day",
    f"WITH {STREAM}, e AS (SELECT *, CASE WHEN coalesce(k, 0) > 0 THEN k ELSE coalesce(value, 0) END AS impact_score FROM stream), "
    "r AS (SELECT circuit, day, event_id, impact_score, row_number() OVER (PARTITION BY circuit, day ORDER BY impact_score DESC, value DESC, user_id DESC, event_id) AS rank FROM e) "
    "SELECT circuit, CAST(day AS VARCHAR) AS day, event_id, impact_score, rank FROM r WHERE rank <= 5",
)
def _(t):
    rows = stream(t).select("circuit", "day", "event_id", F.col("value").alias("UITI"), F.col("k").alias("UITI_VANO"), F.col("value").alias("DURATION_RAW"), F.col("user_id").alias("USERS"))
    return S.top_events(rows, ["circuit", "day"]).select("circuit", text_day(), "event_id", "impact_score", "rank")


@query(
    "p22_billing_component",
    "SELECT billing_origin_product, sku_name, component, max(usd_per_unit) AS usd_per_unit FROM (" + _SQL["a20_priced_usage"] + ") GROUP BY ALL",
)
def _(t):
    rows = A.priced_usage(_usage(t), ["workspace_id", "billing_origin_product", "sku_name", "usage_unit"])
    return rows.groupBy("billing_origin_product", "sku_name", "component").agg(F.max("usd_per_unit").alias("usd_per_unit"))


@query(
    "p24_hour_names",
    f"WITH {HOURLY} SELECT user_id, CAST(day AS VARCHAR) AS day, temp_0 AS \"h0-temp\", temp_1 AS \"h1-temp\", wind_0 AS \"h0-wind\", wind_1 AS \"h1-wind\" FROM hourly",
)
def _(t):
    names = R.hour_columns(["temp", "wind"], range(2))
    wide = hourly_wide(t).select("user_id", text_day(), *[F.col(f"{n.split('-')[1]}_{n.split('-')[0][1:]}").cast("double").alias(n) for n in names])
    return wide
