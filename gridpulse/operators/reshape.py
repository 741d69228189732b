"""Unions, wide and long forms, normalisation, surrogate ids and de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions.text import short_hash
from gridpulse.scale import global_position


def wide_to_long(wide: DataFrame, keys: Sequence[str], variables: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """One row per key and offset with a column per variable, from ``<variable>_<offset>`` columns."""
    rows = F.array(
        *[
            F.struct(F.lit(o).alias("offset"), *[F.col(f"{v}_{o}").alias(v) for v in variables])
            for o in offsets
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def long_to_wide(long: DataFrame, keys: Sequence[str], variables: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """Inverse of :func:`wide_to_long`; offsets are given, so no extra job looks for them."""
    return long.groupBy(*keys).agg(
        *[F.first(F.when(F.col("offset") == o, F.col(v)), ignorenulls=True).alias(f"{v}_{o}") for v in variables for o in offsets]
    )


def hour_columns(variables: Sequence[str], hours: Sequence[int]) -> list[str]:
    return [f"h{h}-{v}" for h in hours for v in variables]


def surrogate_ids(
    frame: DataFrame, columns: Sequence[str], row_id: str, prefix: str, out: str, width: int = 6
) -> DataFrame:
    """Distinct rows of ``columns`` numbered ``PREFIX000001`` by first appearance (least ``row_id``)."""
    firsts = frame.groupBy(*columns).agg(F.min(row_id).alias("_first"))
    numbered = global_position(firsts, ["_first"], "_pos")
    width = max(width, len(str(firsts.count())))
    padded = F.lpad(F.col("_pos").cast("string"), width, "0")
    return numbered.select(F.concat(F.lit(prefix), padded).alias(out), *columns)


def normalise(
    source: DataFrame, row_id: str, dimensions: Mapping[str, Sequence[str]], surrogate: Mapping[str, tuple[str, Sequence[str], str]]
) -> dict[str, DataFrame]:
    """Split a wide source into dimension tables and a fact.

    ``dimensions``: table to (key first, then dependent) columns. ``surrogate``: table to (id column,
    columns, prefix) for tables without a natural key. The fact keeps row id, the first column of each
    dimension, surrogate ids and every column used by no table.
    """
    tables = {name: source.select(*cols).distinct() for name, cols in dimensions.items()}
    fact = source
    used = {c for cols in dimensions.values() for c in list(cols)[1:]}
    for name, (id_column, cols, prefix) in surrogate.items():
        tables[name] = surrogate_ids(source, cols, row_id, prefix, id_column)
        condition = None
        side = tables[name].select(F.col(id_column), *[F.col(c).alias(f"_n_{c}") for c in cols])
        for c in cols:
            test = F.col(c).eqNullSafe(F.col(f"_n_{c}"))
            condition = test if condition is None else condition & test
        fact = fact.join(side, condition, "left").drop(*[f"_n_{c}" for c in cols])
        used |= set(cols)
    keys = {list(cols)[0] for cols in dimensions.values()}
    tables["fact"] = fact.select(*[c for c in fact.columns if c not in used or c in keys])
    return tables


def reconstruction_gap(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows found on one side only, with multiplicity; empty means the split lost nothing."""
    cols = original.columns
    left = original.withColumn("_side", F.lit(1))
    right = rebuilt.select(*cols).withColumn("_side", F.lit(-1))
    return (
        left.unionByName(right)
        .groupBy(*cols)
        .agg(F.sum("_side").alias("difference"))
        .where("difference <> 0")
    )


def criteria_union(families: Mapping[str, DataFrame], tag: str = "criteria_group") -> DataFrame:
    out = None
    for name, frame in families.items():
        side = frame.withColumn(tag, F.lit(name))
        out = side if out is None else out.unionByName(side, allowMissingColumns=True)
    return out


def point_layer(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Event and asset points by name, located rows only."""
    return (
        events.withColumn("point_kind", F.lit("event"))
        .unionByName(assets.withColumn("point_kind", F.lit("asset")), allowMissingColumns=True)
        .where("latitude is not null and longitude is not null")
    )


def asset_view(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points and segments with a hashed id over their describing fields."""
    fields = ["asset_family", "display_label", "circuit", "municipality", "latitude", "longitude"]
    ends = ["latitude_end", "longitude_end"]
    cols = [*fields, *ends, "geometry_kind"]
    one = points.withColumn("asset_id", F.concat(F.lit("asset-"), short_hash(*fields)))
    two = segments.withColumn("asset_id", F.concat(F.lit("asset-"), short_hash(*fields, *ends)))
    for name in ends:
        if name not in one.columns:
            one = one.withColumn(name, F.lit(None).cast("double"))
    return one.select("asset_id", *cols).unionByName(two.select("asset_id", *cols))


def filter_index(layers: Sequence[DataFrame], columns: Sequence[str] = ("period", "municipality", "circuit")) -> DataFrame:
    out = None
    for layer in layers:
        side = layer.select(*columns).where(F.col(columns[0]).isNotNull()).distinct()
        out = side if out is None else out.unionByName(side)
    return out.distinct()


def circuit_names(sources: Sequence[tuple[DataFrame, str]], first: str = "Todos") -> DataFrame:
    """Trimmed non-blank names over all sources, sorted, the all word on top."""
    out = None
    for frame, column in sources:
        side = frame.select(F.trim(F.col(column).cast("string")).alias("name")).where("name <> ''").distinct()
        out = side if out is None else out.unionByName(side)
    spark = out.sparkSession
    head = spark.range(1).select(F.lit(0).alias("position"), F.lit(first).alias("name"))
    body = out.distinct().where(F.col("name") != first).select(F.lit(1).alias("position"), "name")
    return head.unionByName(body).orderBy("position", "name")


def keep_first(frame: DataFrame, subset: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per subset in the given order; a partial top-1 runs before the shuffle."""
    window = Window.partitionBy(*subset).orderBy(*order)
    return frame.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def fill_from_latest(
    frame: DataFrame, key: str, value: str, ts: str, corrections: DataFrame | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """Blank values filled with the key's most recent non-blank value, then with a correction per key."""
    filled = F.nullif(F.trim(F.col(value)), F.lit(""))
    latest = (
        frame.where(filled.isNotNull())
        .groupBy(key)
        .agg(F.max_by(filled, F.struct(ts, *tie, filled)).alias("_latest"))
    )
    out = frame.join(latest, key, "left")
    pieces = [filled, F.col("_latest")]
    if corrections is not None:
        out = out.join(corrections.select(key, F.col(value).alias("_fix")).dropDuplicates([key]), key, "left")
        pieces.append(F.col("_fix"))
    return out.withColumn(value, F.coalesce(*pieces)).drop("_latest", "_fix")


def down_sample(frame: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Every floor(n / limit)-th row of the total order, starting with the first, ``limit`` rows at most; None: all."""
    if limit is None:
        return frame
    total = frame.count()
    if total <= limit:
        return frame
    step = total // limit
    placed = global_position(frame, order, "_pos")
    return placed.where(((F.col("_pos") - 1) % step == 0) & (F.col("_pos") <= step * limit)).drop("_pos")


def events_by_day(events: DataFrame, day: str = "day") -> DataFrame:
    """Adds the day-of-month bucket 1..31 that map layers are read by."""
    return events.withColumn("map_day", F.dayofmonth(day))


def hash_ordered_sample(frame: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows in the order of the MD5 of their keys, the same on every run; the first ``limit`` of them where given."""
    out = frame.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), *keys)
    return out if limit is None else out.limit(limit)
