"""Star, snapshot, lookup, spatial and pattern joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import clean_text
from gridpulse.operators.patterns import matched_patterns, rule_matches


class DuplicateKeyError(ValueError):
    """The side that must be unique has repeated keys."""


class CoverageError(ValueError):
    """Fewer rows were resolved than required."""


@dataclass(frozen=True)
class Dimension:
    """One left-joined dimension: pairs of (fact column, dimension column); key columns are not repeated."""

    frame: DataFrame
    on: Mapping[str, str]
    columns: Sequence[str] = field(default_factory=tuple)


def star_join(fact: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Fact with every dimension left joined in turn; later ones may use columns of earlier ones.

    Sides are left to Catalyst and AQE, which broadcast by measured size and split skewed partitions. Naming a column
    that is already there is an error; unnamed ones keep the value that came first.
    """
    out = fact
    for i, dim in enumerate(dimensions):
        clash = [c for c in dim.columns if c in out.columns and c not in dim.on.values()]
        if clash:
            raise ValueError(f"columns {clash} of dimension {i} are already in the fact")
        keys = {right: f"_k{i}_{n}" for n, right in enumerate(dim.on.values())}
        wanted = [c for c in (dim.columns or dim.frame.columns) if c not in out.columns]
        side = dim.frame.select(*[F.col(r).alias(k) for r, k in keys.items()], *wanted)
        condition = None
        for left, right in dim.on.items():
            test = F.col(left) == F.col(keys[right])
            condition = test if condition is None else condition & test
        out = out.join(side, condition, "left").drop(*keys.values())
    return out


def require_unique(frame: DataFrame, keys: Sequence[str], name: str = "right side") -> DataFrame:
    repeated = frame.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise DuplicateKeyError(f"{name}: repeated keys {keys}, such as {[tuple(r)[:-1] for r in repeated]}")
    return frame


def validated_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "many_to_one", how: str = "left"
) -> DataFrame:
    """Join that fails when the declared cardinality does not hold."""
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown cardinality {validate}")
    require_unique(right, keys)
    if validate == "one_to_one":
        require_unique(left, keys, "left side")
    return left.join(right, list(keys), how)


def missing_keys(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Distinct child keys without a parent; null keys compare as equal."""
    names = list(keys)
    wanted = child.select(*names).distinct()
    have = parent.select(*[F.col(p).alias(f"_p_{c}") for c, p in keys.items()]).distinct()
    condition = None
    for name in names:
        test = F.col(name).eqNullSafe(F.col(f"_p_{name}"))
        condition = test if condition is None else condition & test
    return wanted.join(have, condition, "left_anti")


@dataclass(frozen=True)
class SnapshotLayer:
    """Monthly snapshots of one asset type; ``attributes`` maps output names to snapshot columns."""

    asset_type: str
    frame: DataFrame
    code: str
    date: str
    attributes: Mapping[str, str]


def snapshot_join(
    events: DataFrame,
    layers: Sequence[SnapshotLayer],
    asset_type: str = "equipment_type",
    code: str = "equipment",
    ts: str = "event_ts",
    how: str = "left",
) -> DataFrame:
    """Attributes of the operated asset in the event's month.

    All layers are stacked into one side keyed by (type, code, month), so there is one join whatever the
    number of asset types. Events of a layered type that find no snapshot are dropped; other types stay.
    """
    stacked = None
    for layer in layers:
        side = layer.frame.select(
            F.lit(layer.asset_type).alias("_type"),
            F.col(layer.code).cast("string").alias("_code"),
            F.trunc(F.col(layer.date), "MM").alias("_month"),
            *[F.col(c).alias(out) for out, c in layer.attributes.items()],
        )
        stacked = side if stacked is None else stacked.unionByName(side, allowMissingColumns=True)
    stacked = stacked.withColumn("_hit", F.lit(True))
    condition = (
        (F.col(asset_type) == F.col("_type"))
        & (F.col(code).cast("string") == F.col("_code"))
        & (F.trunc(F.col(ts), "MM") == F.col("_month"))
    )
    joined = events.join(stacked, condition, how)
    kinds = [layer.asset_type for layer in layers]
    keep = F.col("_hit").isNotNull() | ~F.coalesce(F.col(asset_type).isin(*kinds), F.lit(False))
    return joined.where(keep).drop("_type", "_code", "_month", "_hit")


def split_by_type(frame: DataFrame, kinds: Mapping[str, Sequence[str]], column: str) -> dict[str, DataFrame]:
    """One frame per type with its ordered, repeated-free column list."""
    return {
        kind: frame.where(F.col(column) == kind).select(*dict.fromkeys(names)) for kind, names in kinds.items()
    }


def two_hop_lookup(
    spans: DataFrame,
    supports: DataFrame,
    codes: DataFrame,
    span: str,
    support: str,
    code: str,
    value: str,
    source: str,
) -> DataFrame:
    """Span to support to code to value, with where the value came from and how sure it is."""
    left = spans.select(clean_text(span).alias(span), clean_text(support).alias(support))
    middle = supports.select(clean_text(support).alias(support), clean_text(code).alias(code))
    right = codes.select(clean_text(code).alias(code), clean_text(value).alias(value))
    joined = left.join(middle, support, "left").join(right, code, "left")
    return joined.select(
        span,
        support,
        code,
        value,
        F.when(F.col(value).isNotNull(), F.lit(source)).alias(f"{value}_source"),
        F.when(F.col(value).isNotNull(), "direct_code").otherwise("unresolved").alias(f"{value}_confidence"),
    )


def node_bridge(
    assets: DataFrame, nodes: DataFrame, edges: DataFrame, asset: str, node: str, month: str, start: str, end: str
) -> DataFrame:
    """Assets whose node is an endpoint of an edge in the same month, each once.

    Both endpoints are stacked into one distinct (node, month) set, so the edges are read and shuffled once
    and an endpoint shared by many edges cannot multiply rows.
    """
    ends = edges.select(F.explode(F.array(start, end)).alias(node), month).distinct()
    link = nodes.select(asset, node, month).distinct()
    return assets.join(link, [asset, month]).join(ends, [node, month], "left_semi").drop(node).distinct()


def lookback_hours(
    events: DataFrame,
    readings: DataFrame,
    key: str,
    event_id: str,
    start: str,
    reading_ts: str,
    values: Sequence[str],
    hours: int = 24,
) -> DataFrame:
    """Hourly readings before each event as ``h0-name ... h23-name`` columns.

    The window opens at midnight of the day holding ``start - 24 h``; hours are counted from there. The
    range test is an equi-join on (key, day): each event asks for its one or two days only.
    """
    opening = F.date_trunc("day", F.col(start) - F.expr("INTERVAL 24 HOURS"))
    span_days = 1 + (hours - 1) // 24
    asks = (
        events.select(key, event_id, opening.alias("_open"))
        .withColumn("_day", F.explode(F.array(*[F.date_add(F.to_date("_open"), d) for d in range(span_days)])))
    )
    side = readings.select(key, F.to_date(reading_ts).alias("_day"), F.col(reading_ts).alias("_at"), *values)
    joined = asks.join(side, [key, "_day"], "left").withColumn(
        "_hour", F.floor((F.unix_seconds("_at") - F.unix_seconds("_open")) / 3600)
    )
    picks = [
        F.max(F.when(F.col("_hour") == h, F.col(v))).alias(f"h{h}-{v}") for h in range(hours) for v in values
    ]
    return joined.groupBy(key, event_id).agg(*picks)


def first_match(
    frame: DataFrame, sources: Sequence[tuple[DataFrame, str]], key: str, columns: Sequence[str]
) -> DataFrame:
    """Columns taken from the first source that has the key."""
    out = frame
    for i, (source, source_key) in enumerate(sources):
        side = source.select(
            F.col(source_key).alias(f"_m{i}"), *[F.col(c).alias(f"_s{i}_{c}") for c in columns]
        ).dropDuplicates([f"_m{i}"])
        out = out.join(side, F.col(key) == F.col(f"_m{i}"), "left")
    picked = {
        c: F.coalesce(*[F.col(f"_s{i}_{c}") for i in range(len(sources))]) for c in columns
    }
    spare = [f"_m{i}" for i in range(len(sources))] + [
        f"_s{i}_{c}" for i in range(len(sources)) for c in columns
    ]
    return out.withColumns(picked).drop(*spare)


def wildcard_rules(rules: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Rules kept when a name fits an origin or a destination pattern, with the sorted matches of each side.

    For the few names of one context; :func:`rule_matches` gives a row per match and takes any number of names.
    """
    hits = rule_matches(rules, names, name)
    lists = hits.groupBy("rule_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "origin", F.col("name")))).alias("matched_origin"),
        F.sort_array(F.collect_set(F.when(F.col("side") == "destination", F.col("name")))).alias(
            "matched_destination"
        ),
    )
    return rules.join(lists, "rule_id").select(
        "rule_id", F.round("weight", 4).alias("match_strength"), "matched_origin", "matched_destination"
    )


def catalogue_match(catalogue: DataFrame, names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Catalogue variables found by name or alias, and the same grouped into modes.

    ``catalogue``: variable, mode_id, aliases array.
    """
    patterns = catalogue.select(
        "variable", "mode_id", F.explode(F.array_union(F.array("variable"), "aliases")).alias("pattern")
    )
    hits = matched_patterns(names, name, patterns, ["variable", "mode_id"])
    found = hits.groupBy("variable", "mode_id").agg(F.sort_array(F.collect_set("name")).alias("matched_names"))
    modes = found.groupBy("mode_id").agg(F.sort_array(F.collect_list("variable")).alias("matched_variables"))
    return found, modes


def with_scalars(frame: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row."""
    row = scalars.limit(2).collect()
    if len(row) != 1:
        raise ValueError("scalar side must have exactly one row")
    kinds = {f.name: f.dataType for f in scalars.schema.fields}
    return frame.withColumns({c: F.lit(row[0][c]).cast(kinds[c]) for c in scalars.columns})


def coverage(frame: DataFrame, resolved: Column, minimum: float | None = None) -> DataFrame:
    """Rows, resolved rows and share; fails under ``minimum``."""
    out = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(resolved).alias("resolved_rows"),
    ).select(
        "rows",
        "resolved_rows",
        (F.col("rows") - F.col("resolved_rows")).alias("unresolved_rows"),
        F.when(F.col("rows") > 0, F.round(F.col("resolved_rows") / F.col("rows"), 6)).otherwise(0.0).alias("coverage"),
    )
    if minimum is not None:
        share = out.first()["coverage"]
        if share < minimum:
            raise CoverageError(f"coverage {share:.4f} is below {minimum:.4f}")
    return out


def latest_by_key(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the first in ``order``; a partial top-1 runs before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    out = frame.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")
    return out.select(*columns) if columns else out
