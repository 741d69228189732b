"""Conditional probability views: filtered sample, histogram, options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.aggregates import option_list
from gridpulse.operators.filters import KIND_RANGE, apply_filters, condition_text, filter_kind
from gridpulse.operators.reshape import hash_ordered_sample
from gridpulse.operators.stats import histogram, value_counts


def column_kinds(frame: DataFrame) -> list[tuple[str, str]]:
    """(column, filter kind) from the column types; no data is read."""
    return [(name, filter_kind(kind)) for name, kind in frame.dtypes]


def filter_options(frame: DataFrame, criteria: str, column: str, limit: int | None = None) -> DataFrame:
    return option_list(frame.where(F.col("criteria_group") == criteria), column, limit)


def conditional_view(
    frame: DataFrame,
    criteria: str,
    target: str,
    filters: Sequence[Sequence],
    keys: Sequence[str],
    bins: int = 30,
    sample: int | None = None,
) -> dict[str, DataFrame | str]:
    """Wording, rows in a stable order (the first ``sample`` of them where given), and the distribution over all of them."""
    kinds = dict(column_kinds(frame))
    if target not in kinds:
        raise ValueError(f"column {target!r} does not exist")
    rows = apply_filters(frame.where(F.col("criteria_group") == criteria), filters).where(F.col(target).isNotNull())
    numeric = kinds[target] == KIND_RANGE or dict(frame.dtypes)[target] in ("int", "bigint", "smallint", "tinyint")
    return {
        "text": condition_text(target, criteria, filters),
        "sample": hash_ordered_sample(rows.select(*keys, target), keys, sample),
        "distribution": histogram(rows, target, bins) if numeric else value_counts(rows, target),
    }
