"""Time labels and the resolver that turns a grouping word into a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import OperationError
from ledgerscope.functions.columns import quoted, require_columns, time_column

TIME_UNITS = ("month", "quarter", "year")


def time_label(unit: str, ts: Column) -> Column:
    """``2026-09``, ``2026Q3`` or ``2026``; all three sort by time as text."""
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("Q"), F.quarter(ts).cast("string"))
    if unit == "year":
        return F.date_format(ts, "yyyy")
    raise OperationError(f"unknown time unit {unit}; use one of {', '.join(TIME_UNITS)}")


def with_period(df: DataFrame, unit: str, time_col: str | None = None, name: str = "period") -> DataFrame:
    """Add the time label of each row."""
    return df.withColumn(name, time_label(unit, quoted(time_column(df, time_col))))


def period_start(unit: str, ts: Column) -> Column:
    """First day of the period of a moment; far cheaper per row than its label."""
    return F.trunc(ts.cast("date"), unit)


@dataclass(frozen=True)
class GroupKey:
    """A grouping key: rows are grouped and ordered by ``column`` and shown by its label.

    ``unit`` is set for a time word. Such a key has a few values per year,
    however long the table is, so its groups may be broadcast or ordered in one
    task. The number of values of any other column is unknown.
    """

    column: Column
    unit: str | None = None

    @property
    def calendar(self) -> bool:
        return self.unit is not None

    def label(self, key: Column) -> Column:
        return time_label(self.unit, key) if self.unit else key.cast("string")


def group_key(df: DataFrame, group_by: str, time_col: str | None = None) -> GroupKey:
    """``month``, ``quarter`` and ``year`` are reserved words in any case; others are columns."""
    word = group_by.strip().lower()
    if word in TIME_UNITS:
        return GroupKey(period_start(word, quoted(time_column(df, time_col))), word)
    require_columns(df, group_by)
    return GroupKey(quoted(group_by))


def axis_label(name: str) -> str:
    """Readable form of a column name, for axis titles and evidence keys."""
    return name.replace("_", " ").title()
