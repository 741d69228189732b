"""Context payloads: one JSON document per question, as one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import in_month
from gridpulse.functions.text import short_hash
from gridpulse.operators.aggregates import signals_by_suffix
from gridpulse.operators.filters import ALL, comma_list_predicate
from gridpulse.operators.series import attribution_items

# Record limits per payload.
VIEW_RECORDS, HISTORY_RECORDS, SERIES_RECORDS, MOST_RECORDS = 25, 50, 75, 50


def _lit(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _totals() -> list[Column]:
    def total(name: str, digits: int | None) -> Column:
        value = F.coalesce(F.sum(name), F.lit(0))
        return (F.round(value.cast("double"), digits) if digits else value).alias(name)

    return [
        total("event_count", None),
        total("uiti_total", 4),
        total("uiti_vano_total", 4),
        total("duration_raw_total", 2),
        F.coalesce(F.sum("users_affected_total").cast("double"), F.lit(0.0)).alias("users_affected_total"),
    ]


def _records(frame: DataFrame, order: list[Column], limit: int, fields: dict[str, Column]) -> DataFrame:
    """One row with the ordered record list of at most ``limit`` rows."""
    top = frame.orderBy(*order).limit(limit)
    ranked = top.select(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("r"), F.struct(*[
        F.monotonically_increasing_id().alias("i")]).alias("o"))
    return ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("records"))


def _payload(metrics: DataFrame, records: DataFrame, fields: list[Column]) -> DataFrame:
    # both sides are global aggregates: exactly one row each
    both = metrics.withColumn("_j", F.lit(1)).join(records.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return both.select(F.to_json(F.struct(*fields)).alias("payload"))


def _trace(view: str, scope: str) -> Column:
    return F.struct(F.lit(view).alias("source_view"), F.lit(scope).alias("claim_scope"), F.lit(True).alias("read_only"))


def _num(name: str) -> Column:
    return F.col(name).cast("string")


def dashboard_context(view: DataFrame, period: str, municipality: str, circuits: str | None, name: str = "get_dashboard_context") -> DataFrame:
    """Month view of one municipality: totals, date bounds and the 25 strongest records."""
    rows = view.where((F.col("period") == period) & (F.col("municipality") == municipality) & comma_list_predicate(circuits, "circuit"))
    impact = F.col("uiti_total") + F.col("uiti_vano_total")
    records = _records(
        rows,
        [F.desc(impact), F.desc("event_count"), F.desc("duration_raw_total"), F.col("circuit"), F.col("event_family")],
        VIEW_RECORDS,
        {
            "record_type": F.lit("reliability_daily"), "period": F.col("period"), "municipality": F.col("municipality"),
            "circuit": F.col("circuit"), "event_family": F.col("event_family"), "event_count": F.col("event_count"),
            "uiti": F.round("uiti_total", 4), "uiti_vano": F.round("uiti_vano_total", 4),
            "duration_raw": F.round("duration_raw_total", 2), "users_affected": F.col("users_affected_total"),
        },
    )
    metrics = rows.agg(
        *_totals(),
        F.date_format(F.min("first_event_ts"), "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format(F.max("last_event_ts"), "yyyy-MM-dd HH:mm:ss").alias("end"),
    )
    digest = short_hash(F.lit(name), _lit(period), _lit(municipality), _lit(circuits), "event_count", "uiti_total", "uiti_vano_total")
    scope = (circuits or "").strip() or ALL
    kpi = F.struct("event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total")
    bounds = F.struct("start", "end")
    text = F.concat(
        F.lit(f"Vista {municipality} / {period} / {scope}. Eventos: "), _num("event_count"), F.lit(", UITI: "), _num("uiti_total"),
        F.lit(", UITI_VANO: "), _num("uiti_vano_total"), F.lit("."),
    )
    return _payload(
        metrics,
        records,
        [
            F.lit("view").alias("kind"), F.lit(name).alias("tool_name"),
            F.struct(_lit(period).alias("period"), _lit(municipality).alias("municipality"), _lit(circuits).alias("circuits")).alias("parameters"),
            digest.alias("context_hash"), F.concat(F.lit("view-"), digest).alias("context_id"),
            F.struct(text.alias("text"), F.lit(scope).alias("scope_label")).alias("summary"),
            F.col("records"), F.struct(kpi.alias("kpi_summary"), bounds.alias("date_bounds")).alias("metrics"),
            F.array(*[F.lit(c) for c in "".join(scope.split()).split(",")]).alias("selected_circuits"),
            _trace("month_view", "dashboard_filter_aggregate").alias("traceability"),
        ],
    )


def event_context(events: DataFrame, event_id: str, name: str = "get_event_context") -> DataFrame:
    rows = events.where(F.col("event_id") == F.lit(event_id).try_cast(events.schema["event_id"].dataType))
    record = {
        "event_id": F.col("event_id").cast("string"), "day": F.col("day").cast("string"), "municipality": F.col("municipality"),
        "circuit": F.col("circuit"), "equipment": F.col("equipment"), "event_family": F.col("event_family"), "cause": F.col("cause"),
        "uiti": F.col("UITI"), "uiti_vano": F.col("UITI_VANO"), "duration_raw": F.col("DURATION_RAW"),
    }
    one = rows.orderBy("day", F.desc("UITI_VANO"), "equipment").limit(1)
    records = _records(one, [F.col("day")], 1, record)
    none = F.lit("N/D")
    metrics = one.agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("UITI", "UITI_VANO", "DURATION_RAW")],
        *[F.max(c).alias(c) for c in ("circuit", "equipment", "cause")],
    )
    digest = short_hash(F.lit(name), _lit(event_id), "UITI", "UITI_VANO")
    text = F.concat(
        F.lit("Evento "), F.coalesce("equipment", none), F.lit(" en circuito "), F.coalesce("circuit", none),
        F.lit(". Causa: "), F.coalesce("cause", none), F.lit("."),
    )
    return _payload(
        metrics, records,
        [
            F.lit("event").alias("kind"), F.lit(name).alias("tool_name"), F.struct(_lit(event_id).alias("event_id")).alias("parameters"),
            digest.alias("context_hash"), F.concat(F.lit("event-"), digest).alias("context_id"), F.struct(text.alias("text")).alias("summary"),
            F.col("records"), F.struct("UITI", "UITI_VANO", "DURATION_RAW").alias("metrics"),
            _lit(event_id).alias("event_id"), F.col("circuit"), F.col("equipment"), F.col("cause"),
            _trace("event_details", "event").alias("traceability"),
        ],
    )


def asset_context(assets: DataFrame, asset_id: str, name: str = "get_asset_context") -> DataFrame:
    fields = ("asset_family", "display_label", "municipality", "circuit", "latitude", "longitude")
    one = assets.where(F.col("asset_id") == asset_id).orderBy("asset_id").limit(1)
    records = _records(one, [F.col("asset_id")], 1, {"asset_id": F.col("asset_id"), **{f: F.col(f) for f in fields}})
    metrics = one.agg(*[F.max(f).alias(f) for f in fields])
    digest = short_hash(F.lit(name), _lit(asset_id), "display_label", "circuit")
    text = F.concat(
        F.coalesce("asset_family", F.lit("Activo")), F.lit(" "), F.coalesce(F.col("display_label"), _lit(asset_id)),
        F.lit(" asociado al circuito "), F.coalesce("circuit", F.lit("N/D")), F.lit(" en "), F.coalesce("municipality", F.lit("N/D")), F.lit("."),
    )
    return _payload(
        metrics, records,
        [
            F.lit("asset").alias("kind"), F.lit(name).alias("tool_name"), F.struct(_lit(asset_id).alias("asset_id")).alias("parameters"),
            digest.alias("context_hash"), F.concat(F.lit("asset-"), digest).alias("context_id"), F.struct(text.alias("text")).alias("summary"),
            F.col("records"), F.struct("latitude", "longitude").alias("metrics"), *[F.col(f) for f in fields],
            _trace("asset_view", "asset").alias("traceability"),
        ],
    )


def circuit_history_context(history: DataFrame, circuit: str, start: str, end: str, name: str = "get_circuit_history") -> DataFrame:
    rows = history.where((F.col("circuit") == circuit) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    records = _records(
        rows, [F.desc("day"), F.col("municipality")], HISTORY_RECORDS,
        {
            "day": F.col("day").cast("string"), "municipality": F.col("municipality"), "circuit": F.col("circuit"),
            "event_count": F.col("event_count"), "uiti": F.round("uiti_total", 4), "uiti_vano": F.round("uiti_vano_total", 4),
            "duration_raw": F.round("duration_raw_total", 2), "users_affected": F.col("users_affected_total"),
        },
    )
    metrics = rows.agg(*_totals())
    digest = short_hash(F.lit(name), _lit(circuit), _lit(start), _lit(end), "event_count")
    text = F.concat(F.lit(f"Historial del circuito {circuit} entre {start} y {end}. Eventos: "), _num("event_count"), F.lit("."))
    return _payload(
        metrics, records,
        [
            F.lit("circuit_history").alias("kind"), F.lit(name).alias("tool_name"),
            F.struct(_lit(circuit).alias("circuit"), _lit(start).alias("start_date"), _lit(end).alias("end_date")).alias("parameters"),
            digest.alias("context_hash"), F.concat(F.lit("circuit_history-"), digest).alias("context_id"),
            F.struct(text.alias("text")).alias("summary"), F.col("records"),
            F.struct("event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total").alias("metrics"),
            _lit(circuit).alias("circuit"), _trace("circuit_history", "circuit_history").alias("traceability"),
        ],
    )


def timeseries_context(
    attribution: DataFrame, circuit: str | None, start: str, end: str, dates: str | None, name: str = "get_timeseries_interpretability_context"
) -> DataFrame:
    everyone = not circuit or circuit.lower() == ALL.lower()
    rows = attribution.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if not everyone:
        rows = rows.where(F.col("circuit") == circuit)
    if dates:
        rows = rows.where(F.col("day").cast("string").isin(*"".join(dates.split()).split(",")))
    impact = F.col("uiti_total") + F.col("uiti_vano_total")
    labels = ("circuit", "municipality", "cause", "event_family", "equipment", "equipment_type")
    records = _records(
        rows,
        [F.col("day"), F.desc(impact), F.desc("event_count"), F.desc("duration_raw_total"), *[F.col(c) for c in labels]],
        SERIES_RECORDS,
        {
            "day": F.col("day").cast("string"), **{c: F.col(c) for c in labels}, "event_count": F.col("event_count"),
            "uiti_total": F.round("uiti_total", 4), "uiti_vano_total": F.round("uiti_vano_total", 4),
            "duration_raw_total": F.round("duration_raw_total", 2), "users_affected_total": F.col("users_affected_total"),
        },
    )
    metrics = rows.agg(F.count_distinct("day").alias("critical_date_count"), *_totals())
    digest = short_hash(F.lit(name), _lit(circuit), _lit(start), _lit(end), _lit(dates), "event_count")
    text = F.concat(F.lit(f"Contexto de interpretabilidad UITI entre {start} y {end}. Eventos: "), _num("event_count"), F.lit("."))
    return _payload(
        metrics, records,
        [
            F.lit("timeseries_criticality").alias("kind"), F.lit(name).alias("tool_name"),
            F.struct(
                _lit(circuit).alias("circuit"), _lit(start).alias("start_date"), _lit(end).alias("end_date"), _lit(dates).alias("dates")
            ).alias("parameters"),
            digest.alias("context_hash"), F.concat(F.lit("timeseries-criticality-"), digest).alias("context_id"),
            F.struct(text.alias("text")).alias("summary"), F.col("records"),
            F.struct(
                "critical_date_count", "event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total"
            ).alias("metrics"),
            _lit(circuit).alias("circuit"), _trace("daily_attribution", "timeseries_interpretability").alias("traceability"),
        ],
    )


def view_context(attribution: DataFrame, period: str, municipality: str, circuits: str | None = None) -> dict[str, DataFrame]:
    """KPI row, top circuits, families and causes by UITI + UITI_VANO of one view."""
    rows = attribution.where(
        in_month("day", period) & (F.col("municipality") == municipality) & comma_list_predicate(circuits, "circuit")
    ).withColumn("scope", F.lit("view"))
    both = F.col("uiti_total") + F.col("uiti_vano_total")
    return {
        "kpi": rows.agg(*_totals()),
        "top": attribution_items(rows, ["scope"], ["circuit", "event_family", "cause"], score=both).drop("scope"),
    }


# Weather name suffixes and how each is reduced.
SIGNAL_RULES = {
    "-precip": "sum", "-wind_gust_spd": "max", "-wind_spd": "max", "-rh": "mean", "-temp": "mean",
}


def external_signals(frame: DataFrame, by: list[str]) -> DataFrame:
    return signals_by_suffix(frame, by, SIGNAL_RULES)
