"""Daily series: zero fill, robust features, critical points and periods, enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions.metrics import METRIC_KEYS, metric_key
from gridpulse.scale import RoundTables


@dataclass(frozen=True)
class Thresholds:
    """Fixed default cutoffs of the detector."""

    high_z: float = 3.0
    low_z: float = -2.5
    delta_z: float = 3.0
    high_quantile: float = 0.95
    low_quantile: float = 0.05
    top_share: float = 0.10
    sustained_quantile: float = 0.80
    sustained_days: int = 3
    max_points: int = 5


# Reason detail sentences.
DETAILS = {
    "high_outlier": "{m} esta por encima de la linea base robusta de la ventana.",
    "low_outlier": "{m} esta inusualmente bajo frente a la ventana seleccionada.",
    "increase": "{m} sube bruscamente frente al dia anterior.",
    "decrease": "{m} cae bruscamente frente al dia anterior.",
    "contributor": "El dia aporta una fraccion alta del {m} total de la ventana.",
    "peak": "{m} forma un pico local dentro de la serie.",
}


def zero_filled_daily(
    frame: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str] = METRIC_KEYS,
    day: str = "day",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per series and calendar day; days without data are zero.

    Without ``start``/``end`` each series spans its own first to last day; a reversed window is swapped.
    """
    daily = (
        frame.where(F.col(day).isNotNull())
        .groupBy(*by, day)
        .agg(*[F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics])
    )
    first = F.lit(start).cast("date") if start else F.min(day)
    last = F.lit(end).cast("date") if end else F.max(day)
    spans = daily.groupBy(*by).agg(F.min(day).alias("_d0"), F.max(day).alias("_d1")) if not (start and end) else (
        daily.select(*by).distinct()
    )
    if start and end:
        spans = spans.withColumns({"_d0": first, "_d1": last})
    elif start or end:
        spans = spans.withColumns({"_d0": first} if start else {"_d1": last})
    calendar = spans.select(
        *by,
        F.explode(F.sequence(F.least("_d0", "_d1"), F.greatest("_d0", "_d1"), F.expr("INTERVAL 1 DAY"))).alias(day),
    )
    return calendar.join(daily, [*by, day], "left").fillna(0.0, subset=list(metrics))


def robust_z(frame: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """(x - median) / (1.4826 MAD) per series, for every ``value column: output column``.

    The population deviation stands in for a zero MAD, and the result is 0 where that is zero too. All
    columns share two window steps.
    """
    series = Window.partitionBy(*by)
    names = list(columns)
    step = frame.withColumns(
        {f"_med{i}": F.percentile(c, F.lit(0.5)).over(series) for i, c in enumerate(names)}
        | {f"_sd{i}": F.stddev_pop(c).over(series) for i, c in enumerate(names)}
    )
    step = step.withColumns({f"_gap{i}": F.abs(F.col(c) - F.col(f"_med{i}")) for i, c in enumerate(names)})
    step = step.withColumns(
        {f"_mad{i}": F.percentile(f"_gap{i}", F.lit(0.5)).over(series) * 1.4826 for i in range(len(names))}
    )
    out = {}
    for i, c in enumerate(names):
        scale = F.when(F.col(f"_mad{i}") > 0, F.col(f"_mad{i}")).when(F.col(f"_sd{i}") > 0, F.col(f"_sd{i}"))
        out[columns[c]] = F.coalesce((F.col(c) - F.col(f"_med{i}")) / scale, F.lit(0.0))
    spare = [f"_{n}{i}" for i in range(len(names)) for n in ("med", "sd", "gap", "mad")]
    return step.withColumns(out).drop(*spare)


def rolling_median(value: str, by: Sequence[str], day: str, days: int, least: int) -> Column:
    frame = Window.partitionBy(*by).orderBy(day).rowsBetween(1 - days, 0)
    return F.when(F.count(value).over(frame) >= least, F.percentile(value, F.lit(0.5)).over(frame))


def series_features(
    series: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRIC_KEYS, day: str = "day"
) -> DataFrame:
    """Rolling medians, robust z, day change, change share and z, window share and 7-day sum per metric.

    All windows share the series partitioning, so the whole set needs one shuffle. A series has one row per
    day, which bounds the partition whatever the raw volume.
    """
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(day)
    new = {}
    for metric in metrics:
        k = metric.lower()
        before = F.lag(metric).over(ordered)
        total = F.sum(metric).over(whole)
        new.update(
            {
                f"{k}_rolling_median_7d": rolling_median(metric, by, day, 7, 3),
                f"{k}_rolling_median_30d": rolling_median(metric, by, day, 30, 7),
                f"{k}_delta_1d": F.coalesce(F.col(metric) - before, F.lit(0.0)),
                f"{k}_delta_pct": F.when(F.abs(before) > 1e-9, (F.col(metric) - before) / before),
                f"{k}_contribution_pct": F.when(total > 0, F.col(metric) / total).otherwise(0.0),
                f"rolling_7d_{k}_sum": F.sum(metric).over(ordered.rowsBetween(-6, 0)),
            }
        )
    pairs = {}
    for k in (m.lower() for m in metrics):
        pairs[f"{k}_delta_1d"] = f"{k}_delta_robust_z"
    values = {m: f"{m.lower()}_robust_z" for m in metrics}
    return robust_z(series.withColumns(new), by, {**values, **pairs})


def window_shares(series: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRIC_KEYS) -> DataFrame:
    """Share of the window total per metric."""
    totals = {m: F.sum(m).over(Window.partitionBy(*by)) for m in metrics}
    return series.withColumns(
        {f"{m.lower()}_contribution_pct": F.when(total > 0, F.col(m) / total).otherwise(0.0) for m, total in totals.items()}
    )


def _reason(kind: str, metric: str, score: Column, value: Column, base: Column, limit: Column, text: str) -> Column:
    return F.struct(
        F.lit(kind).alias("reason_type"),
        F.lit(metric).alias("metric"),
        F.round(F.greatest(score, F.lit(0.0)), 4).alias("score"),
        F.round(value, 4).alias("value"),
        F.round(base, 4).alias("baseline"),
        F.round(limit.cast("double"), 4).alias("threshold"),
        F.lit(DETAILS[text].format(m=metric)).alias("detail"),
    )


def point_reasons(
    features: DataFrame, by: Sequence[str], metric: str = "UITI", day: str = "day", limits: Thresholds = Thresholds()
) -> DataFrame:
    """Adds ``reasons``: why each day stands out (zero scores dropped; empty for series without impact)."""
    metric = metric_key(metric)
    k = metric.lower()
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(day)
    x, z = F.col(metric), F.col(f"{k}_robust_z")
    change, change_z = F.col(f"{k}_delta_1d"), F.col(f"{k}_delta_robust_z")
    share = F.col(f"{k}_contribution_pct")
    out = features.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_total": F.sum(metric).over(whole),
            "_high": F.percentile(metric, F.lit(limits.high_quantile)).over(whole),
            "_low": F.percentile(metric, F.lit(limits.low_quantile)).over(whole),
            "_base": F.percentile(metric, F.lit(0.5)).over(whole),
            "_active": F.greatest(F.count_if(x > 0).over(whole), F.lit(1)),
            "_prev": F.lag(metric).over(ordered),
            "_next": F.lead(metric).over(ordered),
        }
    )
    n, high, low, base = F.col("_n"), F.col("_high"), F.col("_low"), F.col("_base")
    needed_share = F.greatest(F.lit(limits.top_share), F.least(F.lit(0.5), F.lit(1.5) / F.col("_active")))
    high_z = F.lit(limits.high_z)
    delta_unit = max(limits.delta_z, 1.0)
    checks = [
        (
            (x > 0) & ((z >= high_z) | ((n >= 7) & (x >= high) & (high > 0) & (z >= 1.0))),
            _reason(
                f"{k}_high_outlier", metric,
                F.least(F.greatest(F.abs(z) / max(limits.high_z, 1.0), share), F.lit(2.0)),
                x, base, high_z, "high_outlier",
            ),
        ),
        (
            (base > 0) & (x <= low) & (z <= limits.low_z),
            _reason(
                f"{k}_low_outlier", metric, F.abs(z) / max(abs(limits.low_z), 1.0), x, base, high_z, "low_outlier"
            ).withField("threshold", F.lit(float(limits.low_z))),
        ),
        (
            (change > 0) & ((change_z >= limits.delta_z) | ((base > 0) & (change >= base) & (x >= high))),
            _reason(
                f"sharp_{k}_increase", metric, F.greatest(change_z / delta_unit, share), change, base,
                F.lit(limits.delta_z), "increase",
            ),
        ),
        (
            (change < 0)
            & ((change_z <= -limits.delta_z) | ((base > 0) & (-change >= base) & F.col("_prev").isNotNull())),
            _reason(
                f"sharp_{k}_decrease", metric, F.abs(change_z) / delta_unit, change, base, F.lit(-limits.delta_z),
                "decrease",
            ),
        ),
        (
            (share >= needed_share) & (x > 0),
            _reason(f"top_{k}_contributor", metric, share / needed_share, x, base, needed_share, "contributor"),
        ),
        (
            (n >= 7) & (F.col("_prev") < x) & (F.col("_next") < x) & (x > high),
            _reason(f"local_{k}_peak", metric, share, x, base, high, "peak"),
        ),
    ]
    found = F.array_compact(F.array(*[F.when((F.col("_total") > 0) & test, made) for test, made in checks]))
    return out.withColumn("reasons", F.filter(found, lambda r: r["score"] > 0)).drop(
        "_n", "_total", "_high", "_low", "_base", "_active", "_prev", "_next"
    )


def rank_points(
    reasoned: DataFrame,
    by: Sequence[str],
    day: str = "day",
    metrics: Sequence[str] = METRIC_KEYS,
    max_points: int = 5,
) -> DataFrame:
    """Best days per series: score = min(sum of reasons + largest share, 10), later day first on ties."""
    best_share = F.greatest(*[F.col(f"{m.lower()}_contribution_pct") for m in metrics], F.lit(0.0))
    total = F.aggregate("reasons", F.lit(0.0), lambda acc, r: acc + r["score"])
    by_score = F.array_sort(
        "reasons", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    )
    scored = reasoned.where(F.size("reasons") > 0).withColumns(
        {
            "criticality_score": F.round(F.least(total + best_share, F.lit(10.0)), 4),
            "criticality_types": F.array_sort(F.array_distinct(F.transform("reasons", lambda r: r["reason_type"]))),
            "reasons": by_score,
        }
    )
    scored = scored.withColumn(
        "selection_reason",
        F.concat_ws(" ", F.transform(F.slice("reasons", 1, 2), lambda r: r["detail"])),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("criticality_score"), F.desc(day))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_points)


def sustained_periods(
    series: DataFrame, by: Sequence[str], metric: str = "UITI", day: str = "day", limits: Thresholds = Thresholds()
) -> DataFrame:
    """Runs of consecutive days above the cutoff lasting at least the least length; best five per series."""
    metric = metric_key(metric)
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(day)
    base_cut = F.greatest(F.col("_base") * 1.5, F.col("_base") + 0.01)
    staged = series.withColumns(
        {
            "_base": F.percentile(metric, F.lit(0.5)).over(whole),
            "_p": F.percentile(metric, F.lit(limits.sustained_quantile)).over(whole),
            "_total": F.sum(metric).over(whole),
            "_pos": F.row_number().over(ordered),
        }
    ).withColumn("_cut", F.when(F.col("_p") > F.col("_base"), F.least("_p", base_cut)).otherwise(base_cut))
    active = staged.where((F.col(metric) > F.col("_cut")) & (F.col("_total") > 0))
    runs = active.withColumn("_run", F.col("_pos") - F.row_number().over(ordered)).groupBy(*by, "_run").agg(
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        F.count(F.lit(1)).alias("days"),
        F.round(F.sum(metric) / F.greatest(F.max("_total"), F.lit(1e-9)), 4).alias("score"),
    )
    order = whole.orderBy(F.desc("score"), "start_date")
    return (
        runs.where(F.col("days") >= limits.sustained_days)
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 5")
        .select(
            *by, "rank", "start_date", "end_date", "days", "score",
            F.lit(metric).alias("metric"),
            F.lit(f"sustained_{metric.lower()}_elevated_period").alias("period_type"),
        )
    )


def quality_flags(
    daily: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str] = METRIC_KEYS,
    day: str = "day",
    events: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Sorted flags per series: invalid, missing or repeated dates, negative values, short or empty window.

    With ``events`` given, a series without any event row and with impact is flagged as unattributed. Series of
    ``expected`` that have no row at all are flagged as empty.
    """
    num = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics}
    per_day = daily.groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(num[m]).alias(f"_min_{m}") for m in metrics],
        F.sum(sum(num.values(), F.lit(0.0))).alias("_sum"),
    )
    stats = per_day.groupBy(*by).agg(
        F.sum("_rows").alias("n"),
        F.count(day).alias("days"),
        F.bool_or(F.col(day).isNull()).alias("bad"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("span"),
        F.bool_or(F.col(day).isNotNull() & (F.col("_rows") > 1)).alias("repeated"),
        F.sum("_sum").alias("total"),
        *[F.min(f"_min_{m}").alias(f"_min_{m}") for m in metrics],
    )
    unattributed = F.lit(False)
    if events is not None:
        have = events.select(*by).distinct().withColumn("_has", F.lit(True))
        stats = stats.join(have, list(by), "left")
        unattributed = F.col("_has").isNull() & (F.col("total") != 0)
    flags = [
        ("invalid_dates", F.col("bad")),
        ("missing_dates", F.col("span") > F.col("days")),
        ("duplicated_dates", F.col("repeated")),
        *[(f"negative_{m.lower()}_values", F.col(f"_min_{m}") < 0) for m in metrics],
        ("short_window", F.col("n") < 7),
        ("all_zero_window", F.col("total") == 0),
        ("missing_event_attribution", unattributed),
    ]
    listed = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags])))
    out = stats.select(*by, listed.alias("flags"))
    if expected is not None:
        absent = expected.select(*by).distinct().join(daily.select(*by).distinct(), list(by), "left_anti")
        out = out.unionByName(absent.withColumn("flags", F.array(F.lit("empty_time_series"))))
    return out


def attribution_items(
    frame: DataFrame,
    by: Sequence[str],
    dimensions: Sequence[str],
    limit: int = 5,
    impact: str = "uiti_total",
    score: Column | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Top labels per group and dimension, ranked by score, event count and duration.

    The share is of the group's own score, or of its ``total`` in ``totals`` (``by`` and ``total``) where that is given.

    ``frame`` has uiti_total, uiti_vano_total, event_count, duration_raw_total, users_affected_total. Blank
    labels become "Sin dato"; groups whose event counts sum to zero count rows instead. Every dimension is
    served by one unpivot and one aggregation.
    """
    sums = ["event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total"]
    sides = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit("Sin dato")).alias("label"),
            )
            for d in dimensions
        ]
    )
    tall = frame.select(*by, *sums, F.explode(sides).alias("_s")).select(*by, "_s.dimension", "_s.label", *sums)
    grouped = tall.groupBy(*by, "dimension", "label").agg(
        *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums],
        F.count(F.lit(1)).alias("_rows"),
    )
    grouped = grouped.withColumn("impact_score", score if score is not None else F.col(impact))
    # read twice below; stored, so that the rows behind it are read once
    grouped = RoundTables(frame.sparkSession).store(grouped)
    keys = [*by, "dimension"]
    sums = grouped.groupBy(*keys).agg(F.sum("event_count").alias("_events"), F.sum("impact_score").alias("_total"))
    if totals is not None:
        sums = sums.drop("_total").join(totals.select(*by, F.col("total").alias("_total")), list(by), "left")
    counted = F.when(F.col("_events") == 0, F.col("_rows").cast("double")).otherwise(F.col("event_count"))
    share = F.when(F.col("_total") > 0, F.round(F.col("impact_score") / F.col("_total"), 4))
    grouped = grouped.join(sums, keys).withColumns({"event_count": counted, "contribution_pct": share}).drop(
        "_rows", "_events", "_total"
    )
    # ranking alone in its window keeps the partial top-k before the shuffle, however many labels a group has
    order = Window.partitionBy(*keys).orderBy(F.desc("impact_score"), F.desc("event_count"), F.desc("duration_raw_total"), "label")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_events(
    details: DataFrame, by: Sequence[str], limit: int = 5, impact: str = "UITI", span_impact: str = "UITI_VANO",
    duration: str = "DURATION_RAW", users: str = "USERS", tie: str = "event_id",
) -> DataFrame:
    """Events with the largest impact per group; span impact counts where positive, else event impact."""
    strength = F.when(F.coalesce(F.col(span_impact), F.lit(0.0)) > 0, F.col(span_impact)).otherwise(
        F.coalesce(F.col(impact), F.lit(0.0))
    )
    order = Window.partitionBy(*by).orderBy(
        F.desc("impact_score"), F.desc(duration), F.desc(users), tie
    )
    return (
        details.withColumn("impact_score", strength)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def daily_signals(frame: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, signal, total) for each numeric column that has any value in the group."""
    sums = frame.groupBy(*by).agg(
        *[F.sum(F.col(c).try_cast("double")).alias(c) for c in columns]
    )
    tall = sums.unpivot(list(by), list(columns), "signal", "total")
    return tall.where("total is not null").withColumn("total", F.round("total", 2))


# Names of the label lists of a point, in the order in which the leading group is looked for.
GROUPS = {"cause": "top_causes", "event_family": "top_event_families", "equipment": "top_equipment", "circuit": "top_circuits"}


def group_name(dimension: str) -> str:
    return GROUPS.get(dimension, f"top_{dimension}")


def enrich_points(
    points: DataFrame,
    attribution: DataFrame,
    details: DataFrame,
    by: Sequence[str],
    dimensions: Sequence[str] = ("cause", "event_family", "equipment", "circuit"),
    environment: DataFrame | None = None,
    signals: Sequence[str] = (),
    metric: str = "UITI",
) -> DataFrame:
    """Points with the top labels per dimension, top events, signals, flags and confidence.

    A day without attribution rows is attributed by its event rows, for the dimensions that ``details`` has. Label shares
    are of the point's own ``metric``. Points, and the attribution and event rows of their (series, day) keys, are stored
    once and read by every later step.
    """
    keys = list(by)
    tables = RoundTables(points.sparkSession)
    points = tables.store(points)
    chosen = points.select(*keys).distinct()
    sums = ["event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total"]
    own = [d for d in dimensions if d not in keys]
    sources = tables.store(attribution.join(chosen, keys, "left_semi").select(*keys, *own, *sums))
    events = tables.store(details.join(chosen, keys, "left_semi"))
    bare = chosen.join(sources.select(*keys).distinct(), keys, "left_anti")
    totals = {"uiti_total": "UITI", "uiti_vano_total": "UITI_VANO", "duration_raw_total": "DURATION_RAW", "users_affected_total": "USERS"}
    loose = events.join(bare, keys, "left_semi").withColumn("event_count", F.lit(0)).withColumns({k: F.col(v) for k, v in totals.items()})
    share = points.select(*keys, F.col(metric).alias("total"))
    items = attribution_items(sources, keys, dimensions, totals=share)
    if there := [d for d in dimensions if d in events.columns]:
        items = items.unionByName(attribution_items(loose, keys, there, totals=share))
    item = F.struct("rank", "label", "event_count", "uiti_total", "uiti_vano_total", "duration_raw_total", "users_affected_total", "contribution_pct")
    names = {d: group_name(d) for d in dimensions}
    lists = items.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("dimension") == d, item))).alias(n) for d, n in names.items()]
    )
    best = top_events(events, keys)
    event = F.struct("rank", "event_id", F.round("impact_score", 4).alias("impact_score"), "DURATION_RAW", "USERS")
    event_lists = best.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("top_events"))
    counts = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_events"), F.sum(F.coalesce(F.col("UITI_VANO"), F.lit(0.0))).alias("_impact")
    )
    attributed = sources.select(*keys).distinct().withColumn("_attributed", F.lit(True))
    out = points.join(lists, keys, "left").join(event_lists, keys, "left").join(counts, keys, "left").join(attributed, keys, "left")
    out = out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in [*names.values(), "top_events"]})
    if environment is not None and signals:
        sig = daily_signals(environment.join(chosen, keys, "left_semi"), keys, signals)
        sig = sig.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("signal", "total"))).alias("external_signals"))
        out = out.join(sig, keys, "left")
    no_source = F.col("_attributed").isNull() & F.col("_events").isNull()
    flags = F.array_compact(
        F.array(
            F.when(no_source & (F.col("EVENT_COUNT") > 0), F.lit("missing_event_attribution")),
            F.when((F.col("_events") > 0) & (F.col("_impact") == 0), F.lit("event_detail_without_metric_contribution")),
        )
    )
    out = out.withColumn("data_quality_flags", flags)
    return out.withColumn(
        "confidence",
        F.when(F.size("data_quality_flags") > 0, "low").when(no_source, "medium").otherwise("high"),
    ).drop("_events", "_impact", "_attributed")


def trend_summary(series: DataFrame, by: Sequence[str], metric: str = "UITI", day: str = "day") -> DataFrame:
    """First and last value, their difference, the earliest day of the largest value and days above zero."""
    return series.groupBy(*by).agg(
        F.round(F.min_by(metric, day), 4).alias("first_value"),
        F.round(F.max_by(metric, day), 4).alias("last_value"),
        F.round(F.max_by(metric, day) - F.min_by(metric, day), 4).alias("delta"),
        F.max_by(day, F.struct(F.col(metric), -F.unix_date(day))).alias("max_date"),
        F.round(F.max(metric), 4).alias("max_value"),
        F.count_if(F.col(metric) > 0).alias("nonzero_days"),
    )
