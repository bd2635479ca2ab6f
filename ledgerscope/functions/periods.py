"""Period texts such as ``2026``, ``2026-09``, ``September`` and ``September 2026``."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import EmptyResultError, PeriodError
from ledgerscope.functions.columns import data_type, quoted, time_column
from ledgerscope.functions.labels import period_start, time_label

MONTH_NUMBERS = {name.lower(): number for number, name in enumerate(calendar.month_name) if name}

# The date spellings that select their whole month.
MONTH_FORMATS = ("%Y-%m", "%Y/%m", "%m/%Y", "%B %Y", "%b %Y", "%B, %Y")
DAY_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
    "%d %B %Y", "%B %d, %Y", "%B %d %Y", "%d %b %Y", "%b %d, %Y", "%b %d %Y",
    "%Y.%m.%d", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%f", "%m/%d/%Y %H:%M", "%Y/%m/%d %H:%M:%S",
)
COMPACT_DAY = "%Y%m%d"  # eight digits


@dataclass(frozen=True)
class Period:
    """A half-open range of dates, or one calendar month of every year."""

    start: datetime | None = None
    end: datetime | None = None
    month: int | None = None


def parse_period(text: str) -> Period:
    words = " ".join(text.split())
    if words.isascii() and words.isdigit() and len(words) == 4 and int(words) > 0:
        return Period(datetime(int(words), 1, 1), _january(int(words) + 1))
    if words.lower() in MONTH_NUMBERS:
        return Period(month=MONTH_NUMBERS[words.lower()])
    compact = (COMPACT_DAY,) if words.isascii() and words.isdigit() and len(words) == 8 else ()
    for pattern in MONTH_FORMATS + DAY_FORMATS + compact:
        try:
            day = datetime.strptime(words, pattern)
        except ValueError:
            continue
        start = datetime(day.year, day.month, 1)
        end = _january(day.year + 1) if day.month == 12 else datetime(day.year, day.month + 1, 1)
        return Period(start, end)
    raise PeriodError(f"unsupported period: {text!r}")


def _january(year: int) -> datetime | None:
    return datetime(year, 1, 1) if year <= 9999 else None


def period_condition(period: Period, ts: Column, type_name: str) -> Column:
    """Plain comparisons with literals of the column's own type, so a scan can skip row groups."""
    if period.month is not None:
        return F.month(ts) == period.month
    condition = ts >= F.lit(period.start.strftime("%Y-%m-%d")).cast(type_name)
    if period.end is not None:
        condition &= ts < F.lit(period.end.strftime("%Y-%m-%d")).cast(type_name)
    return condition


def period_filter(
    df: DataFrame,
    period: str | None,
    time_col: str | None = None,
    month_col: str | None = None,
    require_rows: bool = False,
) -> DataFrame:
    """Keep the rows of a period; a missing or blank period keeps all rows.

    ``month_col`` names a ``yyyy-MM`` partition column of the table, if it has
    one: the same period is then also a partition filter.
    """
    if period is not None and period.strip():
        parsed = parse_period(period)
        column = time_column(df, time_col)
        df = df.where(period_condition(parsed, quoted(column), data_type(df, column).simpleString()))
        if month_col is not None:
            df = df.where(_month_partitions(parsed, quoted(month_col)))
    if require_rows and df.isEmpty():
        raise EmptyResultError(f"no rows are left in period {period!r}")
    return df


def _month_partitions(period: Period, label: Column) -> Column:
    if period.month is not None:
        return F.substring(label, 6, 2) == f"{period.month:02d}"
    condition = label >= period.start.strftime("%Y-%m")
    return condition if period.end is None else condition & (label < period.end.strftime("%Y-%m"))


def label_period(unit: str, label: str) -> Period:
    """The range behind a time label such as ``2026-09``, ``2026Q3`` or ``2026``."""
    if unit != "quarter":
        return parse_period(label)
    year, _, quarter = label.partition("Q")
    if not (year.isdigit() and quarter in ("1", "2", "3", "4")):
        raise PeriodError(f"not a quarter label: {label!r}")
    last = parse_period(f"{year}-{int(quarter) * 3:02d}")
    return Period(datetime(int(year), int(quarter) * 3 - 2, 1), last.end)


def distinct_periods(df: DataFrame, unit: str = "month", time_col: str | None = None) -> DataFrame:
    """The periods that occur, with their row counts, oldest first."""
    ts = quoted(time_column(df, time_col))
    return (
        df.where(ts.isNotNull())
        .groupBy(period_start(unit, ts).alias("start"))
        .agg(F.count("*").alias("rows"))
        .select(time_label(unit, F.col("start")).alias("period"), "rows")
        .orderBy("period")
    )


def latest_periods(df: DataFrame, n: int = 2, unit: str = "month", time_col: str | None = None) -> DataFrame:
    """The last ``n`` periods that occur, newest first; the row counts show a partial one."""
    return distinct_periods(df, unit, time_col).orderBy(F.desc("period")).limit(n)
