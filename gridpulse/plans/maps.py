"""Map layers of one period, municipality and circuit choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.aggregates import map_extent
from gridpulse.operators.filters import choose_circuits


def map_layers(
    assets: DataFrame,
    segments: DataFrame,
    events: DataFrame,
    period: str,
    municipality: str,
    circuits: str | Sequence[str] | None = None,
    day: int | None = None,
) -> dict[str, DataFrame]:
    """Assets and segments by municipality and circuit; events also by period and day.

    Supports carry no circuit, so they are hidden when circuits are chosen.
    """
    here = F.col("municipality") == municipality
    points = choose_circuits(assets.where(here), circuits)
    if circuits is not None and "asset_family" in assets.columns:
        points = points.where(F.col("asset_family") != "Supports")
    lines = choose_circuits(segments.where(here), circuits)
    found = choose_circuits(events.where(here & (F.col("period") == period)), circuits)
    days = found.groupBy(F.dayofmonth("day").alias("map_day")).agg(F.count(F.lit(1)).alias("events"))
    chosen = found.where(F.dayofmonth("day") == day) if day is not None else found
    return {"assets": points, "segments": lines, "events": chosen, "days": days, "extent": map_extent([chosen, points, lines])}


def filter_metadata(index: DataFrame, period: str | None = None, municipality: str | None = None) -> dict[str, DataFrame]:
    """Periods newest first, municipalities of a period, circuits of both."""
    rows = index if period is None else index.where(F.col("period") == period)
    inner = rows if municipality is None else rows.where(F.col("municipality") == municipality)
    return {
        "periods": index.select("period").distinct().orderBy(F.desc("period")),
        "municipalities": rows.select("municipality").distinct().orderBy("municipality"),
        "circuits": inner.select("circuit").distinct().orderBy("circuit"),
    }
