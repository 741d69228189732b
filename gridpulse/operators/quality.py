"""Keys, dependencies, profiles and the validation report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.joins import missing_keys


@dataclass(frozen=True)
class TableSpec:
    """Declared shape of a table."""

    name: str
    required: Sequence[str] = ()
    primary_key: Sequence[str] = ()
    natural_key: Sequence[str] = ()
    foreign_keys: Sequence[tuple[Mapping[str, str], str]] = ()
    date_columns: Sequence[str] = ()
    expected_rows: int | None = None
    extra: Mapping[str, str] = field(default_factory=dict)


class ValidationFailure(RuntimeError):
    """At least one check failed."""


def key_counts(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a null in the key, repeated keys and rows in repeated keys."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    groups = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(null_key).alias("has_null"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def dependency_violations(frame: DataFrame, key: Sequence[str], dependent: Sequence[str], nonblank: str | None = None) -> DataFrame:
    """Keys that go with more than one combination of the dependent columns, and how many."""
    checked = frame.where(F.col(nonblank) != "") if nonblank else frame
    return (
        checked.select(*key, *dependent)
        .distinct()
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("distinct_rows"))
        .where("distinct_rows > 1")
    )


def dependency_examples(frame: DataFrame, key: Sequence[str], dependent: Sequence[str], keys: int = 5) -> DataFrame:
    """Offending combinations of the first violating keys."""
    bad = dependency_violations(frame, key, dependent).orderBy(*key).limit(keys)
    return frame.select(*key, *dependent).distinct().join(bad.select(*key), list(key), "left_semi")


def value_conflicts(frame: DataFrame, code: str, value: str) -> DataFrame:
    """Codes with several values, each value with its row count."""
    pairs = frame.where(F.col(code).isNotNull() & F.col(value).isNotNull()).groupBy(code, value).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    per_code = pairs.groupBy(code).agg(F.count(F.lit(1)).alias("distinct_values")).where("distinct_values > 1")
    return pairs.join(per_code, code)


def profile(frame: DataFrame, few: int = 10, approximate: bool = False) -> DataFrame:
    """Type, nulls, null percent, distinct values and the few-values mark per column.

    Exact distinct counts go through one (column, value) de-duplication, so no column is gathered anywhere;
    ``approximate`` uses sketches in a single pass.
    """
    names = frame.columns
    types = F.create_map(*[F.lit(x) for pair in frame.dtypes for x in pair])
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n_{i}") for i, c in enumerate(names)]
    if approximate:
        aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_d_{i}") for i, c in enumerate(names)]
    row = frame.agg(*aggs)
    item = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"_n_{i}").alias("null_count"),
            (F.col(f"_d_{i}") if approximate else F.lit(None).cast("long")).alias("_d"), F.col("_rows"),
        )
        for i, c in enumerate(names)
    ]
    out = row.select(F.explode(F.array(*item)).alias("_s")).select("_s.*")
    if not approximate:
        tall = frame.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("_s")
        ).select("_s.column", "_s.v").where("v is not null")
        counts = tall.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("_e"))
        out = out.join(counts, "column", "left").withColumn("_d", F.coalesce("_e", F.lit(0))).drop("_e")
    return out.select(
        "column",
        types[F.col("column")].alias("dtype"),
        "null_count",
        F.when(F.col("_rows") > 0, F.round(100.0 * F.col("null_count") / F.col("_rows"), 4)).otherwise(0.0).alias("null_percent"),
        F.col("_d").alias("distinct_count"),
        (F.col("_d") <= few).alias("few_values"),
    )


def _result(spark, check: str, table: str, failing: Column, detail: Column, source: DataFrame) -> DataFrame:
    return source.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.when(failing, "FAIL").otherwise("PASS").alias("status"),
        detail.cast("string").alias("detail"),
    )


def validation_report(tables: Mapping[str, DataFrame], specs: Sequence[TableSpec]) -> DataFrame:
    """One row per check: table present, required columns, row count, keys, foreign keys."""
    spark = next(iter(tables.values())).sparkSession
    rows, parts = [], []
    for spec in specs:
        frame = tables.get(spec.name)
        rows.append(("table_exists", spec.name, "PASS" if frame is not None else "FAIL", "" if frame is not None else "missing"))
        if frame is None:
            continue
        absent = [c for c in spec.required if c not in frame.columns]
        rows.append(("required_columns", spec.name, "FAIL" if absent else "PASS", ",".join(absent)))
        if spec.expected_rows is not None:
            counted = frame.agg(F.count(F.lit(1)).alias("n"))
            parts.append(_result(spark, "row_count", spec.name, F.col("n") != spec.expected_rows, F.col("n"), counted))
        for label, keys in (("primary_key", spec.primary_key), ("natural_key", spec.natural_key)):
            if keys and not set(keys) - set(frame.columns):
                counts = key_counts(frame, keys)
                parts.append(_result(spark, f"{label}_unique", spec.name, F.col("duplicate_keys") > 0, F.col("duplicate_keys"), counts))
                if label == "primary_key":
                    parts.append(_result(spark, "primary_key_not_null", spec.name, F.col("null_key_rows") > 0, F.col("null_key_rows"), counts))
        for keys, parent in spec.foreign_keys:
            if parent in tables:
                orphans = missing_keys(frame, tables[parent], keys).agg(F.count(F.lit(1)).alias("n"))
                parts.append(_result(spark, f"foreign_key_{parent}", spec.name, F.col("n") > 0, F.col("n"), orphans))
    out = spark.createDataFrame(rows, "check string, table string, status string, detail string")
    for part in parts:
        out = out.unionByName(part)
    return out


def require_passing(report: DataFrame) -> DataFrame:
    failing = report.where("status = 'FAIL'").limit(20).collect()
    if failing:
        raise ValidationFailure("; ".join(f"{r['table']}.{r['check']} {r['detail']}" for r in failing))
    return report


def missing_columns(required: Sequence[str], present: Sequence[str]) -> list[str]:
    have = {c.strip().lower() for c in present}
    return [c for c in required if c.strip().lower() not in have]
