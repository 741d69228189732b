"""Window coercion, circuit choice and the typed filter list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import clean_text, in_month

# The word for "all", filter kinds and comparison signs.
ALL = "Todos"
KIND_CHOICE, KIND_RANGE, KIND_DATE = "seleccion", "rango_num", "fecha"


def date_bounds(frame: DataFrame, day: str = "day") -> tuple[date | None, date | None]:
    row = frame.agg(F.min(F.to_date(day)).alias("a"), F.max(F.to_date(day)).alias("b")).first()
    return row["a"], row["b"]


def coerce_window(
    start: date | str | None, end: date | str | None, low: date | None, high: date | None, default_days: int = 180
) -> tuple[date | None, date | None]:
    """Missing ends default to the last ``default_days`` days; reversed ends are swapped; then clamp.

    Without bounds (an empty table) two given ends are kept, swapped where reversed; else both are None.
    """

    def parse(value):
        if value is None or isinstance(value, date):
            return value
        try:
            return date.fromisoformat(str(value)[:10])
        except ValueError:
            return None

    if low is None or high is None:
        ends = sorted(e for e in (parse(start), parse(end)) if e)
        return (ends[0], ends[1]) if len(ends) == 2 else (None, None)
    last = parse(end) or high
    first = parse(start) or max(low, high - timedelta(days=max(default_days - 1, 0)))
    if first > last:
        first, last = last, first
    return max(first, low), min(last, high)


def in_window(frame: DataFrame, start: date | None, end: date | None, day: str = "day") -> DataFrame:
    """Rows of the window; a stored table's ``month`` partitions outside it are not read."""
    if start is None or end is None:
        return frame
    if day == "day" and dict(frame.dtypes).get("month") == "date":
        frame = frame.where(F.col("month").between(F.lit(start.replace(day=1)), F.lit(end)))
    return frame.where(F.col(day).between(F.lit(start), F.lit(end)))


def circuit_predicate(choice: str | Sequence[str] | None, column: str = "circuit") -> Column | None:
    """None or the all word: no predicate; empty list: nothing; else membership of the trimmed, distinct names."""
    if choice is None:
        return None
    names = [choice] if isinstance(choice, str) else list(choice)
    if not names:
        return F.lit(False)
    names = list(dict.fromkeys(str(n).strip() for n in names if n is not None and str(n).strip()))
    if not names or any(n.lower() == ALL.lower() for n in names):
        return None
    return F.col(column) == names[0] if len(names) == 1 else F.col(column).isin(*names)


def choose_circuits(frame: DataFrame, choice: str | Sequence[str] | None, column: str = "circuit") -> DataFrame:
    test = circuit_predicate(choice, column)
    return frame if test is None else frame.where(test)


def filter_kind(dtype: str) -> str:
    """Kind of filter a column type gets: text and integers a choice, other numbers a range, times a date range."""
    kind = dtype.lower()
    if kind in ("date",) or kind.startswith("timestamp"):
        return KIND_DATE
    if kind in ("double", "float") or kind.startswith("decimal"):
        return KIND_RANGE
    return KIND_CHOICE


_COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def _moment(value) -> datetime | None:
    try:
        return datetime.fromisoformat(str(value))
    except ValueError:
        return None


def filter_predicates(
    filters: Sequence[Sequence], columns: Sequence[str], frame_types: Sequence[tuple[str, str]] | None = None
) -> list[Column]:
    """Predicates of the filter rows ``[kind, column, first, second]``; incomplete or unknown rows are skipped."""
    out = []
    for item in filters or []:
        kind, name, first, second = (list(item) + [None] * 4)[:4]
        if name not in columns or first in (None, ""):
            continue
        if kind == KIND_CHOICE:
            kind_of = dict(frame_types or {}).get(name, "string")
            number = kind_of in ("tinyint", "smallint", "int", "bigint")
            # the argument takes the column's type, so that the test reaches the scan
            out.append(F.col(name) == F.lit(str(first)).try_cast(kind_of) if number else F.col(name).cast("string") == str(first))
        elif kind == KIND_RANGE and second not in (None, "") and first in _COMPARE:
            try:
                out.append(_COMPARE[first](F.col(name).cast("double"), float(str(second).replace(",", "."))))
            except ValueError:
                continue
        elif kind == KIND_DATE and second not in (None, ""):
            low, high = sorted((_moment(first), _moment(second)), key=lambda m: m or datetime.max)
            if low is None or high is None:
                continue
            is_date = dict(frame_types or {}).get(name) == "date"
            column = F.col(name) if is_date else F.col(name).cast("timestamp")
            out.append(
                column.between(F.lit(low.date()), F.lit(high.date())) if is_date else column.between(F.lit(low), F.lit(high))
            )
    return out


def apply_filters(frame: DataFrame, filters: Sequence[Sequence]) -> DataFrame:
    tests = filter_predicates(filters, frame.columns, frame.dtypes)
    return frame.where(reduce(lambda a, b: a & b, tests)) if tests else frame


def condition_text(target: str, criteria: str, filters: Sequence[Sequence]) -> str:
    """``P(target | criteria, column = value, ...)`` wording of the same filter list."""
    parts = [f"P({target} | {criteria}"]
    for item in filters or []:
        kind, name, first, second = (list(item) + [None] * 4)[:4]
        if not (kind and name and first):
            continue
        if kind == KIND_CHOICE:
            parts.append(f"{name} = {first}")
        elif kind == KIND_RANGE and second is not None:
            parts.append(f"{name} {first} {second}")
        elif kind == KIND_DATE and second:
            parts.append(f"{name} {first} - {second}")
    return ", ".join(parts) + ")"


def explorer_filter(
    frame: DataFrame, equal: dict[str, str | None], day: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Trimmed equality for each existing column unless the all word or blank; inclusive date limits."""
    out = frame
    for name, value in equal.items():
        if name in frame.columns and value and value.strip() and value.strip() != ALL:
            out = out.where(clean_text(name) == value.strip())
    if day and day in frame.columns:
        typed = dict(frame.dtypes)[day] in ("date", "timestamp", "timestamp_ntz")
        when = F.col(day) if typed else F.to_date(day)
        if start:
            out = out.where(when >= F.lit(start).cast("date"))
        if end:
            out = out.where(when < F.date_add(F.lit(end).cast("date"), 1))
    return out


def lon_lat_share(frame: DataFrame, lon: Sequence[str], lat: Sequence[str], least: float = 0.95) -> DataFrame:
    """Rows, rows whose coordinates are all in range, and whether their share is ``least`` or more."""
    good = None
    for names, edge in ((lon, 180.0), (lat, 90.0)):
        for name in names:
            test = F.col(name).cast("double").between(-edge, edge)
            good = test if good is None else good & test
    return frame.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(good, F.lit(False))).alias("valid")
    ).withColumn("lon_lat_ok", F.coalesce((F.col("total") > 0) & (F.col("valid") / F.col("total") >= least), F.lit(False)))


def period_mask(frame: DataFrame, period: str | None, municipality: str | None, date_column: str, name: str = "municipality") -> DataFrame:
    out = frame
    if period:
        out = out.where(in_month(date_column, period))
    if municipality:
        out = out.where(clean_text(name) == municipality.strip())
    return out


def comma_list_predicate(argument: str | None, column: str) -> Column:
    """Membership in a comma list whose blanks are removed; null, empty or the all word admit every row."""
    text = "".join((argument or "").split())
    if not text or text.lower() == ALL.lower():
        return F.lit(True)
    return F.col(column).isin(*text.split(","))


def only_days(frame: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows on the chosen days; an empty choice keeps nothing."""
    return frame.join(days.select(*keys).distinct(), list(keys), "left_semi")


# Name fragments that bar a variable from intervention.
BARRED_FRAGMENTS = ("id", "fecha", "date", "uiti", "saidi", "saifi", "target", "outcome", "causa")


def usable_variables(registry: DataFrame, name: str = "variable") -> DataFrame:
    text = F.lower(F.trim(F.col(name)))
    barred = reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in BARRED_FRAGMENTS])
    return registry.where((F.length(text) > 0) & ~barred)
