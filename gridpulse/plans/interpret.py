"""Summary and interpretability of a date window, as lazy plans over gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.metrics import METRIC_KEYS, METRIC_TOTALS, metric_key
from gridpulse.operators.aggregates import window_totals
from gridpulse.operators.documents import BASE_TERMS, with_distinct_terms
from gridpulse.operators.filters import choose_circuits, coerce_window, date_bounds, in_window
from gridpulse.operators.series import (
    GROUPS,
    Thresholds,
    attribution_items,
    enrich_points,
    point_reasons,
    quality_flags,
    rank_points,
    series_features,
    sustained_periods,
    trend_summary,
    window_shares,
    zero_filled_daily,
)


def metric_columns(daily: DataFrame) -> DataFrame:
    """Gold totals under their metric keys."""
    return daily.withColumns({k: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in METRIC_TOTALS.items()})


def summary(daily: DataFrame, start: str | None, end: str | None, circuit=None) -> dict[str, DataFrame]:
    """Window totals of the five metrics and the zero-filled daily series.

    A choice without rows gives a zero for each day of the window. An empty table has no bounds: a window with both ends
    is taken as given, otherwise the series is empty.
    """
    low, high = date_bounds(daily)
    first, last = coerce_window(start, end, low, high)
    chosen = metric_columns(in_window(choose_circuits(daily, circuit), first, last))
    scoped = chosen.select(F.lit("all").alias("scope"), "day", *METRIC_KEYS)
    if first is not None:  # a row of zeros opens the series whatever the choice holds
        zero = daily.sparkSession.range(1).select(
            F.lit("all").alias("scope"), F.lit(first).cast("date").alias("day"), *[F.lit(0.0).alias(k) for k in METRIC_KEYS]
        )
        scoped = scoped.unionByName(zero)
    series = zero_filled_daily(scoped, ["scope"], METRIC_KEYS, start=first and str(first), end=last and str(last))
    return {"totals": window_totals(chosen, {k: k for k in METRIC_KEYS}), "daily": series.drop("scope")}


def summary_metadata(daily: DataFrame) -> DataFrame:
    """Bounds, number of circuits and municipalities."""
    pairs = daily.groupBy("circuit", "municipality").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return pairs.agg(
        F.min("a").alias("min_date"), F.max("b").alias("max_date"),
        F.count_distinct("circuit").alias("circuits"), F.count_distinct("municipality").alias("municipalities"),
    )


def critical_points(
    series: DataFrame, by: Sequence[str], metric: str = "UITI", limits: Thresholds = Thresholds(), max_points: int = 5
) -> DataFrame:
    """Ranked critical days of every series; the other metrics enter by their window shares only."""
    metric = metric_key(metric)
    others = [m for m in METRIC_KEYS if m != metric]
    features = window_shares(series_features(series, by, [metric]), by, others)
    return rank_points(point_reasons(features, by, metric, limits=limits), by, max_points=max_points)


def interpretability(
    daily: DataFrame,
    attribution: DataFrame,
    details: DataFrame,
    by: Sequence[str] = ("circuit",),
    metric: str = "UITI",
    start: str | None = None,
    end: str | None = None,
    circuit=None,
    max_points: int = 5,
    environment: DataFrame | None = None,
    signals: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Points with explanations, periods, flags and the 365-day history, for every series at once.

    The chosen days reach the detail tables as a semi-join, so nothing is collected between the steps.
    """
    metric = metric_key(metric)
    low, high = date_bounds(daily)
    first, last = coerce_window(start, end, low, high)
    by = list(by)
    chosen = metric_columns(choose_circuits(daily, circuit))
    window = in_window(chosen, first, last)
    series = zero_filled_daily(window, by, start=first and str(first), end=last and str(last))
    points = critical_points(series, by, metric, max_points=max_points)
    enriched = enrich_points(points, attribution, details, [*by, "day"], environment=environment, signals=signals)
    year = max(d for d in (low, last - timedelta(days=364)) if d) if last else None
    history = zero_filled_daily(in_window(chosen, year, last), by, start=year and str(year), end=last and str(last))
    return {
        "points": enriched,
        "periods": sustained_periods(series, by, metric),
        "flags": quality_flags(window, by, expected=chosen),
        "history_totals": window_totals(history, {k: k for k in METRIC_KEYS}, by),
        "history_trend": trend_summary(history, by, metric),
        "history_points": critical_points(history, by, metric, max_points=max_points),
        "history_periods": sustained_periods(history, by, metric),
        "history_labels": attribution_items(
            in_window(attribution, year, last), by, [d for d in ("cause", "event_family", "equipment", "circuit") if d not in by]
        ),
    }


def plain_number(name: str, digits: int) -> Column:
    """Rounded value as plain decimal text with at least one decimal, never with an exponent."""
    text = F.regexp_replace(F.round(F.coalesce(F.col(name), F.lit(0.0)), digits).cast(f"decimal(38,{digits})").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


# Sentences about the strongest point of a series, and about a series without one.
NO_POINTS = (
    "No se detectaron puntos criticos entre {start} y {end}. "
    "La serie no muestra picos, aportes concentrados ni cambios bruscos bajo los umbrales actuales."
)
NO_GROUP = "sin agrupacion dominante disponible"


def insight_lines(points: DataFrame, by: Sequence[str], start: str, end: str, series: DataFrame | None = None) -> DataFrame:
    """One fixed-text line per series about its top point; series of ``series`` without points get a line that says so.

    The leading group is the first label of the first of causes, families, equipment and circuits that has one.
    """
    counted = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    first = points.where("rank = 1").join(counted, list(by))
    leading = F.lit(NO_GROUP)
    for name in reversed([n for n in GROUPS.values() if n in points.columns]):
        item = F.get(F.col(name), F.lit(0))
        leading = F.when(item.isNotNull(), F.concat(item["label"], F.lit(f" ({name})"))).otherwise(leading)
    text = F.concat(
        F.lit("Se detectaron "), F.col("_n").cast("string"), F.lit(f" eventos de interes entre {start} y {end}. "),
        F.lit("El evento de mayor criticidad fue "), F.col("day").cast("string"),
        F.lit(", con UITI="), plain_number("UITI", 4), F.lit(" y UITI_VANO="), plain_number("UITI_VANO", 4),
        F.lit(". Se selecciono por: "), F.coalesce(F.nullif(F.col("selection_reason"), F.lit("")), F.array_join("criticality_types", ", ")),
        F.lit(". En ese dia se registraron "), F.coalesce(F.col("EVENT_COUNT"), F.lit(0)).cast("long").cast("string"), F.lit(" eventos, "),
        plain_number("DURATION_RAW", 2), F.lit(" unidades de duracion fuente acumulada y "), plain_number("USERS", 2),
        F.lit(" usuarios afectados. La principal agrupacion observada fue "), leading,
        F.lit(". Los intervalos sin evento registrado no se interpretan como anomalias por si mismos."),
    )
    lines = first.select(*by, text.alias("insight"))
    if series is None:
        return lines
    none = F.lit(NO_POINTS.format(start=start, end=end))
    return series.select(*by).distinct().join(lines, list(by), "left").withColumn("insight", F.coalesce("insight", none))


def retrieval_queries(points: DataFrame, by: Sequence[str], metric: str = "UITI", labels: int = 5, limit: int = 40) -> DataFrame:
    """One retrieval query per series, from its enriched points: ``query_text`` of at most ``limit`` distinct terms.

    Base terms come first, then the metric and the series, the types of its points by rank, and up to ``labels`` labels of
    each group. A term that differs only in case is taken once.
    """
    groups = [n for n in GROUPS.values() if n in points.columns]
    ranked = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "criticality_types", *groups))).alias("_p"))
    leading = F.array(*[F.lit(t) for t in (*BASE_TERMS, metric_key(metric))], *[F.col(c).cast("string") for c in by])
    types = F.flatten(F.transform("_p", lambda p: p["criticality_types"]))

    def named(group: str) -> Column:
        found = F.flatten(F.transform("_p", lambda p: F.transform(p[group], lambda x: x["label"])))
        return F.slice(F.array_distinct(found), 1, labels)

    return with_distinct_terms(ranked, F.concat(leading, types, *[named(n) for n in groups]), limit=limit).drop("_p")
