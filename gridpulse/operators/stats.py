"""Histograms, densities, describe, correlation, relevance and data preparation for models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.scale import exact_quantiles, global_position


def histogram(frame: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from minimum to maximum with counts and probabilities; empty bins are listed.

    One pass finds the limits, one pass counts; a constant column gets a width of one around its value. Values that are
    not finite take no part in limits and probabilities; where there are any, a row without bin counts them.
    """
    raw = F.col(column).cast("double")
    finite = ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    value = F.when(finite, raw)
    row = frame.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("n"), F.count_if(~finite).alias("odd")).first()
    spark = frame.sparkSession
    schema = "bin int, low double, high double, n long, probability double"
    odd = spark.createDataFrame([(None, None, None, row["odd"], None)] if row["odd"] else [], schema)
    if not row["n"]:
        return odd
    low, high = float(row["a"]), float(row["b"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    counts = frame.where(value.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    binned = edges.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / F.lit(row["n"])).alias("probability"),
    )
    return binned.unionByName(odd) if row["odd"] else binned


def density(frame: DataFrame, column: str, grid: Sequence[float], by: str | None = None, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density at the grid points, per group when ``by`` is given (groups with several rows).

    Scott's rule sets the bandwidth of each group. The kernel sums are aggregates, one per grid point, so
    they combine on the map side and no (row, grid point) pair is ever materialised.
    """
    value = F.col(column).cast("double")
    keys = [by] if by else []
    rows = frame.where(value.isNotNull()).select(*keys, value.alias("_x"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_s")).where("_n > 1 and _s > 0")
    h = F.lit(float(bandwidth)) if bandwidth else F.col("_s") * F.pow(F.col("_n"), -0.2)
    if by:
        joined = rows.join(stats.withColumn("_h", h), by)
    else:
        one = stats.withColumn("_h", h).first()
        if one is None:
            return frame.sparkSession.createDataFrame([], "x double, density double")
        joined = rows.withColumns({"_n": F.lit(one["_n"]), "_h": F.lit(float(one["_h"]))})
    scale = F.max(F.col("_n") * F.col("_h")) * 2.5066282746310002
    sums = joined.groupBy(*keys).agg(
        *[
            (F.sum(F.exp(-F.pow((F.lit(float(g)) - F.col("_x")) / F.col("_h"), 2) / 2)) / scale).alias(f"_g{i}")
            for i, g in enumerate(grid)
        ]
    )
    points = F.array(*[F.struct(F.lit(float(g)).alias("x"), F.col(f"_g{i}").alias("density")) for i, g in enumerate(grid)])
    return sums.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.x", "_p.density")


def value_counts(frame: DataFrame, column: str, limit: int = 30) -> DataFrame:
    return (
        frame.groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(limit)
    )


def describe_numeric(frame: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum."""
    value = F.col(column).cast("double")
    base = frame.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(frame, column, [0.25, 0.5, 0.75])
    q = quartiles.first()
    return base.select(
        "count", "mean", "std", "min",
        *[F.lit(q[i]).cast("double").alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
        "max",
    )


def describe_text(frame: DataFrame, column: str) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("top"),
        F.max("n").alias("freq"),
    )


def correlations(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, r) over the non-constant columns, computed in one aggregation."""
    spread = frame.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    kept = [c for c in columns if spread[c]]
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[i:]]
    if not pairs:
        return frame.sparkSession.createDataFrame([], "left string, right string, r double")
    row = frame.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    both = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            both.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(f"_{i}").alias("r")))
    return row.select(F.explode(F.array(*both)).alias("_p")).select("_p.*")


def target_correlations(frame: DataFrame, columns: Sequence[str], target: str, least: float = 0.1) -> DataFrame:
    """Columns whose correlation with the target exceeds ``least`` in size."""
    row = frame.agg(*[F.corr(c, target).alias(c) for c in columns])
    tall = row.unpivot([], list(columns), "feature", "r")
    return tall.where(F.abs("r") > least)


def column_relevance(masks: DataFrame, columns: Sequence[str], group: str | None = None, limit: int = 20) -> DataFrame:
    """Mean row softmax per column over all rows, mean raw weight per column in each group; best ``limit`` of each."""
    # one step per stage: the row maximum and the row total are computed once per row
    top = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    shifted = masks.withColumn("_top", top).select(*[F.exp(F.col(c) - F.col("_top")).alias(c) for c in columns])
    summed = shifted.withColumn("_total", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))
    soft = summed.select(*[(F.col(c) / F.col("_total")).alias(c) for c in columns])
    means = [F.avg(c).alias(c) for c in columns]
    out = soft.agg(*means).select(F.lit("all").alias("scope"), *columns)
    if group:
        grouped = masks.groupBy(F.col(group).cast("string").alias("scope")).agg(*means)
        out = out.unionByName(grouped)
    tall = out.unpivot(["scope"], list(columns), "feature", "relevance")
    order = Window.partitionBy("scope").orderBy(F.desc(F.round("relevance", 9)), "feature")
    return tall.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def tertile_labels(frame: DataFrame, column: str, out: str = "risk", cuts: Sequence[float] = (0.3333, 0.6666)) -> DataFrame:
    """0, 1 or 2 by the exact 33.33 and 66.66 percentiles."""
    q = exact_quantiles(frame, column, list(cuts)).first()
    value = F.col(column)
    if q is None or q[0] is None:
        return frame.withColumn(out, F.lit(None).cast("int"))
    return frame.withColumn(out, F.when(value < q[0], 0).when(value < q[1], 1).when(value.isNotNull(), 2))


def fill_for_model(frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str], text: str = "no aplica") -> DataFrame:
    """Null numbers become -10 times the column maximum, null categories ``no aplica``."""
    peaks = frame.agg(*[F.max(c).alias(c) for c in numeric]).first() if numeric else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(-10.0 * float(peaks[c] or 0.0))) for c in numeric}
    return frame.withColumns({**filled, **{c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c in categorical}})


def class_codes(frame: DataFrame, column: str) -> DataFrame:
    """(class, code from 0 in sorted order, rows) for one categorical column."""
    classes = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    return global_position(classes, ["class"], "_p").select("class", (F.col("_p") - 1).alias("code"), "rows")


def label_encode(frame: DataFrame, column: str, out: str | None = None) -> DataFrame:
    codes = class_codes(frame, column).select(F.col("class").alias("_class"), F.col("code").alias(out or f"{column}_code"))
    return frame.join(codes, F.col(column).cast("string") == F.col("_class"), "left").drop("_class")


def min_max_scale(frame: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Columns mapped to [0, 1]; a constant column maps to 0."""
    row = frame.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        low, high = row[c]["a"], row[c]["b"]
        span = (high - low) if low is not None else 0
        out[f"{c}{suffix}"] = (F.col(c) - F.lit(low)) / F.lit(float(span)) if span else F.when(F.col(c).isNotNull(), 0.0)
    return frame.withColumns(out)


def stratified_split(
    frame: DataFrame, stratum: str, row_id: str, shares: Mapping[str, float], order: Column | None = None
) -> DataFrame:
    """Adds ``split``: rows of every stratum in hash order, cut at the cumulative shares.

    Positions come from range buckets over (stratum, order, id), so a dominant stratum is spread too. Rows without a
    stratum form one of their own.
    """
    keyed = frame.withColumn("_o", order if order is not None else F.xxhash64(row_id))
    placed = global_position(keyed, [stratum, "_o", row_id], "_pos")
    sizes = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    # one row per stratum reaches this window
    starts = sizes.select(F.col(stratum).alias("_st"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = placed.join(starts, F.col(stratum).eqNullSafe(F.col("_st"))).withColumn("_k", F.col("_pos") - F.col("_start"))
    choice, edge = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        test = F.col("_k") <= F.round(F.col("_n") * edge)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return placed.withColumn("split", choice.otherwise(names[-1])).drop("_o", "_pos", "_st", "_n", "_start", "_k")


def hash_split(frame: DataFrame, bucket: Column, shares: Mapping[str, float], buckets: int = 1000) -> DataFrame:
    """Adds ``split`` from a bucket number in ``0 .. buckets-1``."""
    choice, edge = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] * buckets
        choice = F.when(bucket < edge, name) if choice is None else choice.when(bucket < edge, name)
    return frame.withColumn("split", choice.otherwise(names[-1]))


def fill_with_train_mean(frame: DataFrame, columns: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """Null numbers become the training mean of their own column."""
    row = frame.where(F.col(split) == train).agg(*[F.avg(c).alias(c) for c in columns]).first()
    return frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c])) for c in columns})


def regression_errors(frame: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, MAPE (percent, zero actuals left out) and R2."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    mse = F.avg(e * e)
    return frame.groupBy(*by).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias("mape"),
        (1 - F.sum(e * e) / (F.count(a) * F.var_pop(a))).alias("r2"),
    )
