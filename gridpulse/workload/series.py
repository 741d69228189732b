"""Window functions over daily series (W1-W16, A32) and Q6, Q7, Q12."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions.metrics import METRIC_KEYS
from gridpulse.operators import reshape as R
from gridpulse.operators import series as S
from gridpulse.operators.documents import BASE_TERMS, bounded_memory
from gridpulse.operators.joins import latest_by_key
from gridpulse.plans import interpret
from gridpulse.workload.registry import STREAM, query, r4, stream, stream_daily, text_day

BY = ["circuit"]


def filled(t):
    return S.zero_filled_daily(stream_daily(t), BY)


def features(t, metrics=METRIC_KEYS):
    return S.series_features(filled(t), BY, metrics)


def _robust(source: str, value: str, out: str) -> str:
    """CTE adding the robust z of one column."""
    return (
        f"{out}_m AS (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY circuit) AS med FROM {source}), "
        f"{out}_g AS (SELECT *, 1.4826 * quantile_cont(abs({value} - med), 0.5) OVER (PARTITION BY circuit) AS mad, stddev_pop({value}) OVER (PARTITION BY circuit) AS sd FROM {out}_m), "
        f"{out} AS (SELECT * EXCLUDE (med, mad, sd), coalesce(({value} - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd END, 0) AS {out}_z FROM {out}_g)"
    )


OW = "OVER (PARTITION BY circuit ORDER BY day)"
FEATURES = (
    STREAM
    + f", f0 AS (SELECT *, coalesce(UITI - lag(UITI) {OW}, 0) AS delta, lag(UITI) {OW} AS prev, lead(UITI) {OW} AS nxt FROM series), "
    + _robust("f0", "UITI", "rz")
    + ", "
    + _robust("rz", "delta", "dz")
    + ", feat AS (SELECT *, "
    + ", ".join(f"CASE WHEN sum({m}) OVER (PARTITION BY circuit) > 0 THEN {m} / sum({m}) OVER (PARTITION BY circuit) ELSE 0 END AS share_{m}" for m in METRIC_KEYS)
    + " FROM dz)"
)


@query(
    "w01_rolling_median",
    f"WITH {STREAM} SELECT circuit, CAST(day AS VARCHAR) AS day, "
    "CASE WHEN count(*) OVER w7 >= 3 THEN round(quantile_cont(UITI, 0.5) OVER w7, 4) END AS median_7d, "
    "CASE WHEN count(*) OVER w30 >= 7 THEN round(quantile_cont(UITI, 0.5) OVER w30, 4) END AS median_30d FROM series "
    "WINDOW w7 AS (PARTITION BY circuit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY circuit ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
)
def _(t):
    return filled(t).select(
        "circuit", text_day(),
        F.round(S.rolling_median("UITI", BY, "day", 7, 3), 4).alias("median_7d"),
        F.round(S.rolling_median("UITI", BY, "day", 30, 7), 4).alias("median_30d"),
    )


@query("w02_robust_z", f"WITH {FEATURES} SELECT circuit, CAST(day AS VARCHAR) AS day, round(rz_z, 4) AS robust_z FROM feat")
def _(t):
    return S.robust_z(filled(t), BY, {"UITI": "robust_z"}).select("circuit", text_day(), *r4("robust_z"))


@query(
    "w03_day_change",
    f"WITH {FEATURES} SELECT circuit, CAST(day AS VARCHAR) AS day, round(delta, 4) AS delta_1d, "
    "CASE WHEN abs(prev) > 1e-9 THEN round((UITI - prev) / prev, 4) END AS delta_pct, round(dz_z, 4) AS delta_robust_z FROM feat",
)
def _(t):
    return features(t).select(
        "circuit", text_day(), F.round("uiti_delta_1d", 4).alias("delta_1d"), F.round("uiti_delta_pct", 4).alias("delta_pct"),
        F.round("uiti_delta_robust_z", 4).alias("delta_robust_z"),
    )


@query(
    "w04_contribution_share",
    f"WITH {FEATURES} SELECT circuit, CAST(day AS VARCHAR) AS day, "
    + ", ".join(f"round(share_{m}, 4) AS share_{m.lower()}" for m in METRIC_KEYS)
    + ", round(sum(UITI) OVER (PARTITION BY circuit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_7d FROM feat",
)
def _(t):
    return features(t).select(
        "circuit", text_day(),
        *[F.round(f"{m.lower()}_contribution_pct", 4).alias(f"share_{m.lower()}") for m in METRIC_KEYS],
        F.round("rolling_7d_uiti_sum", 4).alias("rolling_7d"),
    )


REASONS = (
    FEATURES
    + ", st AS (SELECT *, count(*) OVER c AS n, sum(UITI) OVER c AS total, quantile_cont(UITI, 0.95) OVER c AS hi, quantile_cont(UITI, 0.05) OVER c AS lo, "
    "quantile_cont(UITI, 0.5) OVER c AS base, greatest(count(*) FILTER (UITI > 0) OVER c, 1) AS active FROM feat WINDOW c AS (PARTITION BY circuit)), "
    "nd AS (SELECT *, greatest(0.10::DOUBLE, least(0.5::DOUBLE, 1.5::DOUBLE / active)) AS need FROM st WHERE total > 0), "
    "rs AS ("
    "SELECT circuit, day, 'uiti_high_outlier' AS reason_type, least(greatest(abs(rz_z) / 3, share_UITI), 2) AS s FROM nd WHERE UITI > 0 AND (rz_z >= 3 OR (n >= 7 AND UITI >= hi AND hi > 0 AND rz_z >= 1)) UNION ALL "
    "SELECT circuit, day, 'uiti_low_outlier', abs(rz_z) / 2.5 FROM nd WHERE base > 0 AND UITI <= lo AND rz_z <= -2.5 UNION ALL "
    "SELECT circuit, day, 'sharp_uiti_increase', greatest(dz_z / 3, share_UITI) FROM nd WHERE delta > 0 AND (dz_z >= 3 OR (base > 0 AND delta >= base AND UITI >= hi)) UNION ALL "
    "SELECT circuit, day, 'sharp_uiti_decrease', abs(dz_z) / 3 FROM nd WHERE delta < 0 AND (dz_z <= -3 OR (base > 0 AND -delta >= base AND prev IS NOT NULL)) UNION ALL "
    "SELECT circuit, day, 'top_uiti_contributor', share_UITI / need FROM nd WHERE share_UITI >= need AND UITI > 0 UNION ALL "
    "SELECT circuit, day, 'local_uiti_peak', share_UITI FROM nd WHERE n >= 7 AND prev < UITI AND nxt < UITI AND UITI > hi), "
    "reasons AS (SELECT circuit, day, reason_type, round(greatest(s, 0), 4) AS score FROM rs WHERE round(greatest(s, 0), 4) > 0)"
)


@query("w05_point_reasons", f"WITH {REASONS} SELECT circuit, CAST(day AS VARCHAR) AS day, reason_type, score FROM reasons")
def _(t):
    rows = S.point_reasons(features(t, ["UITI"]), BY)
    return rows.select("circuit", text_day(), F.explode("reasons").alias("r")).select("circuit", "day", "r.reason_type", "r.score")


@query("w06_local_peaks", f"WITH {REASONS} SELECT circuit, CAST(day AS VARCHAR) AS day, score FROM reasons WHERE reason_type = 'local_uiti_peak'")
def _(t):
    rows = S.point_reasons(features(t, ["UITI"]), BY).select("circuit", text_day(), F.explode("reasons").alias("r"))
    return rows.where("r.reason_type = 'local_uiti_peak'").select("circuit", "day", "r.score")


@query(
    "w07_sustained_periods",
    f"WITH {STREAM}, st AS (SELECT *, quantile_cont(UITI, 0.5) OVER c AS base, quantile_cont(UITI, 0.8) OVER c AS p, sum(UITI) OVER c AS total, row_number() OVER (PARTITION BY circuit ORDER BY day) AS pos FROM series WINDOW c AS (PARTITION BY circuit)), "
    "cu AS (SELECT *, CASE WHEN p > base THEN least(p, greatest(base * 1.5, base + 0.01)) ELSE greatest(base * 1.5, base + 0.01) END AS cut FROM st), "
    "ac AS (SELECT *, pos - row_number() OVER (PARTITION BY circuit ORDER BY day) AS run FROM cu WHERE UITI > cut AND total > 0), "
    "pe AS (SELECT circuit, run, min(day) AS a, max(day) AS b, count(*) AS days, round(sum(UITI) / greatest(max(total), 1e-9), 4) AS score FROM ac GROUP BY circuit, run HAVING count(*) >= 2), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY circuit ORDER BY score DESC, a) AS rank FROM pe) "
    "SELECT circuit, rank, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, days, score, 'sustained_uiti_elevated_period' AS period_type FROM rk WHERE rank <= 5",
)
def _(t):
    rows = S.sustained_periods(filled(t), BY, limits=S.Thresholds(sustained_days=2))
    return rows.select(
        "circuit", "rank", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        "days", "score", "period_type",
    )


RANKED = (
    REASONS
    + ", agg AS (SELECT circuit, day, sum(score) AS total, string_agg(reason_type, ',' ORDER BY reason_type) AS types FROM reasons GROUP BY circuit, day), "
    "sc AS (SELECT agg.circuit, agg.day, types, round(least(total + greatest(share_UITI, share_UITI_VANO, share_EVENT_COUNT, share_USERS, share_DURATION_RAW, 0), 10), 4) AS score, UITI "
    "FROM agg JOIN feat USING (circuit, day)), "
    "points AS (SELECT *, row_number() OVER (PARTITION BY circuit ORDER BY score DESC, day DESC) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY score DESC, day DESC) <= 5)"
)


@query(
    "w08_ranked_points",
    f"WITH {RANKED} SELECT circuit, CAST(day AS VARCHAR) AS day, rank, score AS criticality_score, types AS criticality_types, round(UITI, 4) AS uiti FROM points",
)
def _(t):
    points = interpret.critical_points(filled(t), BY)
    return points.select(
        "circuit", text_day(), "rank", "criticality_score", F.array_join("criticality_types", ",").alias("criticality_types"),
        F.round("UITI", 4).alias("uiti"),
    )


def _attribution(t):
    """Attribution rows of two days in three, so that the other days show the fall-back to event rows."""
    return stream(t).where(F.dayofmonth("day") % 3 != 0).select(
        "circuit", "day", (F.col("user_id") % 7).cast("string").alias("cause"), (F.col("user_id") % 3).cast("string").alias("event_family"),
        F.col("user_id").cast("string").alias("equipment"), F.lit(1).alias("event_count"), F.col("value").alias("uiti_total"), F.col("k").alias("uiti_vano_total"),
        F.col("value").alias("duration_raw_total"), F.lit(1.0).alias("users_affected_total"),
    )


def _details(t):
    """Event rows of five days in six; on days 7, 14, 21 and 28 their span impact is zero."""
    idle = F.dayofmonth("day") % 7 == 0
    return stream(t).where(F.dayofmonth("day") % 6 != 0).select(
        "circuit", "day", "event_id", F.col("value").alias("UITI"), F.when(idle, 0.0).otherwise(F.col("k")).alias("UITI_VANO"), F.col("value").alias("DURATION_RAW"),
        F.lit(1.0).alias("USERS"), (F.col("user_id") % 7).cast("string").alias("cause"), (F.col("user_id") % 3).cast("string").alias("event_family"),
        F.col("user_id").cast("string").alias("equipment"),
    )


ENRICHED = (
    RANKED
    + ", att AS (SELECT * FROM stream WHERE day(day) % 3 <> 0), "
    "det AS (SELECT * REPLACE (CASE WHEN day(day) % 7 = 0 THEN 0 ELSE k END AS k) FROM stream WHERE day(day) % 6 <> 0), "
    "src AS (SELECT circuit, day, user_id, value FROM att UNION ALL SELECT circuit, day, user_id, value FROM det ANTI JOIN att ON det.circuit = att.circuit AND det.day = att.day), "
    "ca AS (SELECT s.circuit, s.day, CAST(user_id % 7 AS VARCHAR) AS label, count(*) AS n, sum(value) AS u FROM src s SEMI JOIN points p ON s.circuit = p.circuit AND s.day = p.day GROUP BY ALL), "
    "cr AS (SELECT *, row_number() OVER (PARTITION BY circuit, day ORDER BY u DESC, n DESC, label) AS r FROM ca), "
    "cl AS (SELECT circuit, day, string_agg(label, ',' ORDER BY r) AS top_causes, max(u) FILTER (r = 1) AS top_u FROM cr WHERE r <= 5 GROUP BY ALL), "
    "ev AS (SELECT s.circuit, s.day, event_id, row_number() OVER (PARTITION BY s.circuit, s.day ORDER BY CASE WHEN coalesce(k, 0) > 0 THEN k ELSE value END DESC, value DESC, event_id) AS r FROM det s SEMI JOIN points p ON s.circuit = p.circuit AND s.day = p.day), "
    "el AS (SELECT circuit, day, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS top_events FROM ev WHERE r <= 5 GROUP BY ALL), "
    "de AS (SELECT circuit, day, count(*) AS n_events, sum(coalesce(k, 0)) AS impact FROM det GROUP BY circuit, day), "
    "rich AS (SELECT points.circuit, points.day, rank, types, series.UITI, series.UITI_VANO, series.EVENT_COUNT, series.USERS, series.DURATION_RAW, coalesce(top_causes, '') AS top_causes, coalesce(top_events, '') AS top_events, "
    "CASE WHEN series.UITI > 0 THEN round(top_u / series.UITI, 4) END AS top_share, "
    "CASE WHEN n_events > 0 AND impact = 0 THEN 'low' WHEN n_events > 0 OR top_u IS NOT NULL THEN 'high' WHEN series.EVENT_COUNT > 0 THEN 'low' ELSE 'medium' END AS confidence, "
    "CASE WHEN n_events > 0 AND impact = 0 THEN 'event_detail_without_metric_contribution' WHEN n_events IS NULL AND top_u IS NULL AND series.EVENT_COUNT > 0 THEN 'missing_event_attribution' ELSE '' END AS flags "
    "FROM points JOIN series USING (circuit, day) LEFT JOIN cl USING (circuit, day) LEFT JOIN el USING (circuit, day) LEFT JOIN de USING (circuit, day))"
)


def _rich(t, dimensions=("cause", "event_family", "equipment")):
    return S.enrich_points(interpret.critical_points(filled(t), BY), _attribution(t), _details(t), ["circuit", "day"], dimensions=dimensions)


@query(
    "w09_enriched_points",
    f"WITH {ENRICHED} SELECT circuit, CAST(day AS VARCHAR) AS day, rank, top_causes, top_events, top_share, confidence, flags FROM rich",
)
def _(t):
    first = F.get("top_causes", F.lit(0))
    return _rich(t).select(
        "circuit", text_day(), "rank", F.array_join(F.transform("top_causes", lambda x: x["label"]), ",").alias("top_causes"),
        F.array_join(F.transform("top_events", lambda x: x["event_id"].cast("string")), ",").alias("top_events"),
        first["contribution_pct"].alias("top_share"), "confidence", F.array_join("data_quality_flags", ",").alias("flags"),
    )


@query(
    "w10_latest_per_key",
    "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = latest_by_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


BLANKED = "b AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS cause FROM orders)"


def _blanked(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("cause")
    )


@query(
    "w11_fill_from_latest",
    f"WITH {BLANKED}, l AS (SELECT o_custkey, cause AS latest FROM b WHERE cause <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) "
    "SELECT o_orderkey, coalesce(nullif(trim(cause), ''), latest, c_mktsegment) AS cause FROM b LEFT JOIN l USING (o_custkey) LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    fixes = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cause"))
    return R.fill_from_latest(_blanked(t), "o_custkey", "cause", "o_orderdate", fixes, tie=["o_orderkey"]).select("o_orderkey", "cause")


@query(
    "w12_keep_first",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    out = R.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.drop("l_shipdate")


@query(
    "w13_surrogate_ids",
    "SELECT 'EVT_' || lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), 6, '0') AS event_key, o_custkey, o_orderpriority FROM "
    "(SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL)",
)
def _(t):
    return R.surrogate_ids(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", "EVT_", "event_key")


@query(
    "w14_bounded_memory",
    "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS brief FROM conversations) "
    "SELECT conv_id, role, text AS content FROM m WHERE back <= 2 UNION ALL "
    "SELECT conv_id, 'assistant', 'Memoria compacta deterministica: ' || count(*) || ' mensajes previos omitidos (' || count(*) FILTER (role = 'user') || ' usuario, ' || count(*) FILTER (role = 'assistant') || "
    "' asistente). Primer tema: ' || coalesce(nullif(left(arg_min(brief, turn), 220), ''), 'N/D') || '. Ultimo tema antes del historial reciente: ' || coalesce(nullif(left(arg_max(brief, turn), 220), ''), 'N/D') || '.' FROM m WHERE back > 2 GROUP BY conv_id",
)
def _(t):
    return bounded_memory(t.conversations, "conv_id", "turn", "role", "text", 1).drop("turn_id")


@query("w16_down_sample", "WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events) SELECT event_id, value FROM p WHERE (pos - 1) % greatest(n // 500, 1) = 0 AND (n <= 500 OR pos <= (n // 500) * 500)")
def _(t):
    return R.down_sample(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], 500).select("event_id", "value")


@query(
    "a32_quality_flags",
    f"WITH {STREAM}, u AS (SELECT user_id, day, value FROM stream), p AS (SELECT user_id, day, count(*) AS c, min(value) AS mn, sum(value) AS s FROM u GROUP BY ALL), "
    "g AS (SELECT user_id, sum(c) AS n, count(day) AS days, date_diff('day', min(day), max(day)) + 1 AS span, bool_or(c > 1) AS rep, min(mn) AS mn, sum(s) AS total FROM p GROUP BY user_id) "
    "SELECT user_id, array_to_string(list_sort(list_filter([CASE WHEN span > days THEN 'missing_dates' END, CASE WHEN rep THEN 'duplicated_dates' END, CASE WHEN mn < 0 THEN 'negative_value_values' END, "
    "CASE WHEN n < 7 THEN 'short_window' END, CASE WHEN total = 0 THEN 'all_zero_window' END], lambda x: x IS NOT NULL)), ',') AS flags FROM g",
)
def _(t):
    rows = stream(t).select("user_id", "day", "value")
    return S.quality_flags(rows, ["user_id"], ["value"]).select("user_id", F.array_join("flags", ",").alias("flags"))


def _gold(t):
    """Silver fact, then daily impact and attribution, each written once and read back."""
    from gridpulse.operators import aggregates as A
    from gridpulse.sources.writers import write_table
    from gridpulse.workload.registry import fact
    from gridpulse.workload.sources import scratch

    def stored(frame, name):
        path = scratch(t.spark, name)
        write_table(frame, path)
        return t.spark.read.parquet(path)

    base = stored(fact(t), "fact")
    daily = stored(A.daily_impact(A.event_rollup(base, coordinates=False)), "daily")
    return daily, A.daily_attribution(base), base


from gridpulse.workload.registry import DAILY  # noqa: E402


@query(
    "q06_summary_totals",
    f"WITH {DAILY}, w AS (SELECT max(day) AS z, greatest(min(day), max(day) - 179) AS a FROM daily) "
    "SELECT round(sum(uiti_total), 4) AS UITI, round(sum(uiti_vano_total), 4) AS UITI_VANO, CAST(sum(event_count) AS DOUBLE) AS EVENT_COUNT, round(sum(users_affected_total), 4) AS USERS, "
    "round(sum(duration_raw_total), 4) AS DURATION_RAW FROM daily, w WHERE day BETWEEN a AND z AND circuit = 'NATION_3'",
)
def _(t):
    return interpret.summary(_gold(t)[0], None, None, "NATION_3")["totals"].select(*r4(*METRIC_KEYS))


@query(
    "q06_summary_daily",
    f"WITH {DAILY}, w AS (SELECT max(day) AS z, greatest(min(day), max(day) - 179) AS a FROM daily), "
    "c AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM w), "
    "d AS (SELECT day, sum(uiti_total) AS u, sum(event_count) AS n FROM daily WHERE circuit IN ('NATION_3', 'NATION_4') GROUP BY day) "
    "SELECT CAST(c.day AS VARCHAR) AS day, round(coalesce(u, 0), 4) AS UITI, CAST(coalesce(n, 0) AS DOUBLE) AS EVENT_COUNT FROM c LEFT JOIN d USING (day)",
)
def _(t):
    out = interpret.summary(_gold(t)[0], None, None, ["NATION_3", " NATION_4", "NATION_3"])["daily"]
    return out.select(text_day(), *r4("UITI", "EVENT_COUNT"))


def _interpret(t):
    daily, attribution, base = _gold(t)
    details = base.select(
        "circuit", "day", "event_id", F.col("event_impact").alias("UITI"), F.col("span_impact").alias("UITI_VANO"), F.col("duration").alias("DURATION_RAW"), F.col("users").alias("USERS")
    )
    return interpret.interpretability(daily, attribution, details)


@query("q07_interpretability_points")
def _(t):
    points = _interpret(t)["points"]
    return points.select(
        "circuit", text_day(), "rank", "criticality_score", F.array_join("criticality_types", ",").alias("criticality_types"), "selection_reason",
        F.to_json("reasons").alias("reasons"), F.to_json("top_causes").alias("top_causes"), F.to_json("top_equipment").alias("top_equipment"),
        F.to_json("top_events").alias("top_events"), "confidence",
    )


GOLD_SERIES = (
    DAILY
    + ", w AS (SELECT max(day) AS z, greatest(min(day), max(day) - 179) AS a FROM daily), dd AS (SELECT circuit, day, sum(uiti_total) AS UITI, sum(uiti_vano_total) AS UITI_VANO, "
    "CAST(sum(event_count) AS DOUBLE) AS EVENT_COUNT, sum(users_affected_total) AS USERS, sum(duration_raw_total) AS DURATION_RAW FROM daily, w WHERE day BETWEEN a AND z GROUP BY ALL), "
    "cal AS (SELECT circuit, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT circuit FROM dd), w), "
    "series AS (SELECT cal.circuit, cal.day, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in METRIC_KEYS) + " FROM cal LEFT JOIN dd USING (circuit, day))"
)
GOLD_POINTS = RANKED.replace(STREAM, GOLD_SERIES)


@query(
    "q07_explained_points",
    f"WITH {GOLD_POINTS}, ca AS (SELECT f.circuit, f.day, cause AS label, count(DISTINCT (event_id, municipality, event_family, equipment, equipment_type)) AS n, sum(span_impact) AS u FROM fact f SEMI JOIN points p ON f.circuit = p.circuit AND f.day = p.day GROUP BY ALL), "
    "cl AS (SELECT circuit, day, arg_max(label, u) AS top_cause FROM ca GROUP BY ALL), "
    "ev AS (SELECT f.circuit, f.day, event_id, row_number() OVER (PARTITION BY f.circuit, f.day ORDER BY CASE WHEN coalesce(span_impact, 0) > 0 THEN span_impact ELSE coalesce(event_impact, 0) END DESC, duration DESC, users DESC, event_id) AS r FROM fact f SEMI JOIN points p ON f.circuit = p.circuit AND f.day = p.day), "
    "el AS (SELECT circuit, day, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS top_events FROM ev WHERE r <= 5 GROUP BY ALL) "
    "SELECT circuit, CAST(day AS VARCHAR) AS day, rank, score AS criticality_score, types AS criticality_types, coalesce(top_cause, '') AS top_cause, coalesce(top_events, '') AS top_events FROM points LEFT JOIN cl USING (circuit, day) LEFT JOIN el USING (circuit, day)",
)
def _(t):
    points = _interpret(t)["points"]
    return points.select(
        "circuit", text_day(), "rank", "criticality_score", F.array_join("criticality_types", ",").alias("criticality_types"),
        F.coalesce(F.get("top_causes", F.lit(0))["label"], F.lit("")).alias("top_cause"),
        F.coalesce(F.array_join(F.transform("top_events", lambda x: x["event_id"].cast("string")), ","), F.lit("")).alias("top_events"),
    )


HISTORY = (
    DAILY
    + ", w AS (SELECT max(day) AS z, greatest(min(day), max(day) - 364) AS a FROM daily), h AS (SELECT circuit, day, sum(uiti_total) AS u, sum(event_count) AS n, sum(users_affected_total) AS us "
    "FROM daily, w WHERE day BETWEEN a AND z GROUP BY circuit, day)"
)


@query(
    "q07_history_totals",
    f"WITH {HISTORY} SELECT circuit, round(sum(u), 4) AS UITI, CAST(sum(n) AS DOUBLE) AS EVENT_COUNT, round(sum(us), 4) AS USERS FROM h GROUP BY circuit",
)
def _(t):
    return _interpret(t)["history_totals"].select("circuit", *r4("UITI", "EVENT_COUNT", "USERS"))


@query(
    "d07_retrieval_queries",
    f"WITH {ENRICHED}, ty AS (SELECT circuit, flatten(list(string_split(types, ',') ORDER BY rank)) AS ty, list_filter(flatten(list(string_split(top_causes, ',') ORDER BY rank)), lambda x: x <> '') AS ca FROM rich GROUP BY circuit), "
    f"te AS (SELECT circuit, list_concat(list_concat([{', '.join(repr(x) for x in BASE_TERMS)}, 'UITI', circuit], ty), list_filter(ca, lambda x, i: list_position(ca, x) = i)[1:5]) AS ts FROM ty), "
    "fi AS (SELECT circuit, list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i)[1:40] AS k FROM te) SELECT circuit, array_to_string(k, ' ') AS query_text FROM fi",
)
def _(t):
    return interpret.retrieval_queries(_rich(t, ("cause",)), BY)


# the sentences of a point's two strongest reasons, strongest first
REASON_TEXT = """(CASE reason_type WHEN 'uiti_high_outlier' THEN 'UITI esta por encima de la linea base robusta de la ventana.'
 WHEN 'uiti_low_outlier' THEN 'UITI esta inusualmente bajo frente a la ventana seleccionada.' WHEN 'sharp_uiti_increase' THEN 'UITI sube bruscamente frente al dia anterior.'
 WHEN 'sharp_uiti_decrease' THEN 'UITI cae bruscamente frente al dia anterior.' WHEN 'top_uiti_contributor' THEN 'El dia aporta una fraccion alta del UITI total de la ventana.'
 ELSE 'UITI forma un pico local dentro de la serie.' END)"""
REASON_PLACE = "list_position(['uiti_high_outlier', 'uiti_low_outlier', 'sharp_uiti_increase', 'sharp_uiti_decrease', 'top_uiti_contributor', 'local_uiti_peak'], reason_type)"


@query(
    "q12_insight_lines",
    f"WITH {ENRICHED}, rt AS (SELECT circuit, day, {REASON_TEXT} AS detail, row_number() OVER (PARTITION BY circuit, day ORDER BY score DESC, {REASON_PLACE}) AS place FROM reasons), "
    "wh AS (SELECT circuit, day, string_agg(detail, ' ' ORDER BY place) AS why FROM rt WHERE place <= 2 GROUP BY circuit, day), "
    "li AS (SELECT circuit, 'Se detectaron ' || n || ' eventos de interes entre 2024-01-01 y 2024-01-30. El evento de mayor criticidad fue ' || day || ', con UITI=' || round(UITI, 4) || ' y UITI_VANO=' || round(UITI_VANO, 4) "
    "|| '. Se selecciono por: ' || why || '. En ese dia se registraron ' || CAST(EVENT_COUNT AS BIGINT) || ' eventos, ' || round(DURATION_RAW, 2) || ' unidades de duracion fuente acumulada y ' || round(USERS, 2) "
    "|| ' usuarios afectados. La principal agrupacion observada fue ' || CASE WHEN top_causes = '' THEN 'sin agrupacion dominante disponible' ELSE split_part(top_causes, ',', 1) || ' (top_causes)' END "
    "|| '. Los intervalos sin evento registrado no se interpretan como anomalias por si mismos.' AS insight "
    "FROM rich JOIN wh USING (circuit, day) JOIN (SELECT circuit, count(*) AS n FROM points GROUP BY circuit) USING (circuit) WHERE rank = 1), "
    "every AS (SELECT DISTINCT circuit FROM series UNION SELECT n_name FROM nation) "
    "SELECT circuit, coalesce(insight, 'No se detectaron puntos criticos entre 2024-01-01 y 2024-01-30. La serie no muestra picos, aportes concentrados ni cambios bruscos bajo los umbrales actuales.') AS insight "
    "FROM every LEFT JOIN li USING (circuit)",
)
def _(t):
    """Every series of the stream, and the circuits of the place table, which have no points."""
    series = filled(t).select("circuit").unionByName(t.nation.select(F.col("n_name").alias("circuit")))
    return interpret.insight_lines(_rich(t), BY, "2024-01-01", "2024-01-30", series=series)
