"""Impact metric map with fixed keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric keys, their total columns and the default key.
METRIC_TOTALS = {
    "UITI": "uiti_total",
    "UITI_VANO": "uiti_vano_total",
    "EVENT_COUNT": "event_count",
    "USERS": "users_affected_total",
    "DURATION_RAW": "duration_raw_total",
}
METRIC_KEYS = tuple(METRIC_TOTALS)
DEFAULT_METRIC = "UITI"


def metric_key(value: str | None) -> str:
    """Upper-cased known key, else the default key."""
    name = (value or "").strip().upper()
    return name if name in METRIC_TOTALS else DEFAULT_METRIC


def metric_key_column(value: Column | str) -> Column:
    name = F.upper(F.trim(F.col(value) if isinstance(value, str) else value))
    return F.when(name.isin(*METRIC_KEYS), name).otherwise(F.lit(DEFAULT_METRIC))


def metric_map(columns: Mapping[str, str] | None = None) -> Column:
    """``map<string,double>`` over the metric keys; null totals count as zero."""
    pairs = []
    for key, name in {**METRIC_TOTALS, **(columns or {})}.items():
        pairs += [F.lit(key), F.coalesce(F.col(name).cast("double"), F.lit(0.0))]
    return F.create_map(*pairs)


def map_to_columns(frame: DataFrame, source: str = "metrics") -> DataFrame:
    """One double column per metric key, taken from the map where the frame lacks it."""
    missing = [k for k in METRIC_KEYS if k not in frame.columns]
    return frame.withColumns({k: F.coalesce(F.element_at(source, F.lit(k)), F.lit(0.0)) for k in missing})
