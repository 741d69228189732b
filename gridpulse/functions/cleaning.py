"""Cleaning, typing and defaulting of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(as_column(value).cast("string")), F.lit(""))


def decimal_number(value: Column | str, default: float | None = None) -> Column:
    """Number from text that may use a decimal comma; anything unreadable becomes null (or ``default``)."""
    number = F.regexp_replace(clean_text(value), ",", ".").try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def parse_timestamp(value: Column | str, pattern: str | None = None) -> Column:
    text = clean_text(value)
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def in_month(day: Column | str, period: str) -> Column:
    """Days of the month ``yyyy-MM`` as a plain range on the column, which scans can use; nothing for other texts."""
    first = F.try_to_date(F.lit(f"{period}-01"), "yyyy-MM-dd")
    return (as_column(day) >= first) & (as_column(day) < F.add_months(first, 1))


def month_period(value: Column | str) -> Column:
    return F.date_format(as_column(value), "yyyy-MM")


def with_time_parts(frame: DataFrame, source: str, ts: str = "event_ts", day: str = "day") -> DataFrame:
    """Adds the parsed timestamp, its day, its month period and its day of month."""
    stamp = parse_timestamp(source)
    return frame.withColumns(
        {
            ts: stamp,
            day: F.to_date(stamp),
            "period": month_period(stamp),
            "day_of_month": F.dayofmonth(stamp),
        }
    )


def first_filled(*values: Column | str, default: object = None) -> Column:
    """First non-blank text of the chain, then the literal default."""
    chain = [clean_text(v) for v in values]
    return F.coalesce(*chain, F.lit(default)) if default is not None else F.coalesce(*chain)


def first_number(*values: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(*[as_column(v).cast("double") for v in values], F.lit(default))


def resolve_alias(frame: DataFrame, candidates: Sequence[str], default: object = None) -> Column:
    """Coalesce over the candidate columns that exist, matched without regard to case and outer spaces."""
    known = {c.strip().lower(): c for c in frame.columns}
    found = [F.col(f"`{known[n.strip().lower()]}`") for n in candidates if n.strip().lower() in known]
    if not found:
        return F.lit(default)
    return F.coalesce(*found) if default is None else F.coalesce(*found, F.lit(default))


def positive_flag(value: Column | str) -> Column:
    return F.when(F.coalesce(as_column(value), F.lit(0.0)) > 0, 1).otherwise(0)


def later_of(*dates: Column | str, default: str = "1900-01-01") -> Column:
    """Latest of several dates, each missing one counting as ``default``."""
    floor = F.lit(default).cast("timestamp")
    return F.greatest(*[F.coalesce(as_column(d), floor) for d in dates])


def timestamp_from_parts(year: str, month: str, day: str, hour: str, minute: str, second: str) -> Column:
    """Timestamp from six columns; impossible parts give null."""
    parts = [F.col(c).try_cast("int") for c in (year, month, day, hour, minute)]
    return F.try_make_timestamp(*parts, F.col(second).try_cast("decimal(16,6)"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    begin, finish = as_column(start).cast("timestamp"), as_column(end).cast("timestamp")
    return (F.unix_micros(finish) - F.unix_micros(begin)) / F.lit(3_600_000_000.0)


def cast_by_schema(frame: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Cast the declared columns; values that do not fit become null, other columns are dropped."""
    return frame.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in schema.items() if c in frame.columns])


def drop_rows_with_null(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return frame.dropna(how="any", subset=list(columns) if columns else None)


def drop_columns_with_null(frame: DataFrame) -> DataFrame:
    """Drop each column that has at least one null, found in one pass over the data."""
    flags = frame.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns]).first()
    return frame.drop(*[c for c in frame.columns if flags[c]])


def trim_column_names(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.lstrip("\ufeff").strip() for c in frame.columns])


def normalize_types(frame: DataFrame, date_columns: Sequence[str] = ()) -> DataFrame:
    """Declared dates to timestamp, numbers to double, containers to JSON text, bytes to text, flags kept."""
    wanted = {c.lower() for c in date_columns}
    out = []
    for field in frame.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if field.name.lower() in wanted:
            col = F.try_to_timestamp(col.cast("string"))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        elif isinstance(kind, T.BinaryType):
            col = F.decode(col, "UTF-8")
        elif isinstance(kind, T.NumericType):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return frame.select(*out)


def label_text(*parts: Column | str, separator: str = " | ") -> Column:
    return F.concat_ws(separator, *[as_column(p).cast("string") for p in parts])


def impact_label(event: Column | str, circuit: Column | str, impact: Column | str) -> Column:
    """Popup label with the impact shown to four decimals."""
    return F.concat_ws(
        " | ",
        as_column(event).cast("string"),
        as_column(circuit),
        F.concat(F.lit("UITI_VANO "), F.format_string("%.4f", as_column(impact))),
    )


def segment_middle(start: Column | str, end: Column | str) -> Column:
    return (as_column(start) + as_column(end)) / 2.0


def row_as_text(frame: DataFrame, columns: Sequence[str] | None = None, separator: str = " | ") -> Column:
    """``name: value`` pairs of one row, leaving out null and blank cells."""
    cells = []
    for name in columns or frame.columns:
        text = clean_text(f"`{name}`")
        cells.append(F.when(text.isNotNull(), F.concat(F.lit(f"{name}: "), text)))
    return F.concat_ws(separator, *cells)


def numeric_risk(columns: Sequence[str]) -> tuple[Column, Column]:
    """Score in [0,1] from the mean of the non-null numbers over 100 (0.5 if none) and its 0.5 label."""
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    raw = total / (F.size(values) * 100.0)
    score = F.when(F.size(values) == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return score, F.when(score >= 0.5, F.lit("high_risk")).otherwise(F.lit("low_risk"))
