"""One-condition filters, match counts and previews."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import LiteralError, OperationError
from ledgerscope.functions.columns import TIME_TYPES, data_type, present, quoted, require_columns

OPERATORS = (
    "equals", "not_equals", "greater_than", "greater_than_or_equal",
    "less_than", "less_than_or_equal", "contains",
)
PREVIEW_LIMIT = 100


def condition(df: DataFrame, column: str, operator: str, value: Any) -> Column:
    """The condition of one filter, checked against the type of its column.

    ``not_equals`` holds for null cells, the other operators do not. A value of
    a kind that the column cannot hold equals nothing and cannot be ordered.
    ``contains`` is a case-insensitive regular expression over the cell as text.
    """
    word = operator.strip().lower()
    if word not in OPERATORS:
        raise OperationError(f"unknown operator {operator!r}; use one of {', '.join(OPERATORS)}")
    dtype = data_type(df, column)
    cell = quoted(column)
    if word == "contains":
        return plain_text(present(df, column), dtype).rlike(f"(?iU){value}")

    literal = _literal(dtype, value)
    if word == "equals":
        return F.lit(False) if literal is None else cell == literal
    if word == "not_equals":
        return F.lit(True) if literal is None else ~cell.eqNullSafe(literal)
    if literal is None:
        raise LiteralError(f"{value!r} cannot be ordered against column {column} ({dtype.simpleString()})")
    if word == "less_than":
        return cell < literal
    if word == "less_than_or_equal":
        return cell <= literal
    ordered = cell > literal if word == "greater_than" else cell >= literal
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return ordered & ~F.isnan(cell)  # Spark sorts NaN above every number
    return ordered


def plain_text(cell: Column, dtype: T.DataType) -> Column:
    """A cell as one would write it: midnight as its date, decimals without closing zeros, doubles without exponent."""
    text = cell.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(text, " 00:00:00$", "")
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        exact = F.regexp_replace(F.regexp_replace(cell.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        return F.when(text.contains("E"), F.coalesce(exact, text)).otherwise(text)
    return text


def _literal(dtype: T.DataType, value: Any) -> Column | None:
    """The value as a literal that leaves the column uncast, or None if the kinds differ."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        if not isinstance(value, (bool, int, float, Decimal)) or (isinstance(value, float) and math.isnan(value)):
            return None
        if isinstance(dtype, T.BooleanType):
            return F.lit(bool(value)) if value in (0, 1) else None
        if isinstance(value, bool):
            value = int(value)
        if isinstance(value, float) and math.isfinite(value):
            if isinstance(dtype, T.DecimalType):
                value = Decimal(str(value))
            elif value.is_integer() and isinstance(dtype, T.IntegralType) and abs(value) < 2**63:
                value = int(value)
        return F.lit(value)
    if isinstance(dtype, TIME_TYPES):
        moment = _moment(value)
        if moment is None:
            return None
        midnight = (moment.hour, moment.minute, moment.second, moment.microsecond) == (0, 0, 0, 0)
        type_name = "timestamp_ntz" if isinstance(dtype, T.DateType) and not midnight else dtype.simpleString()
        return F.lit(moment.isoformat(sep=" ") if not midnight else moment.strftime("%Y-%m-%d")).cast(type_name)
    if isinstance(dtype, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return None


def _moment(value: Any) -> datetime | None:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if not isinstance(value, str):
        return None
    text = value.strip()
    for pattern in ("%Y", "%Y-%m"):
        try:
            return datetime.strptime(text, pattern)
        except ValueError:
            continue
    try:
        moment = datetime.fromisoformat(text)
        return moment if moment.tzinfo is None else moment.astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        return None


def filter_rows(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    """The rows that satisfy one condition."""
    return df.where(condition(df, column, operator, value))


def match_count(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    """One row with the number of matching rows."""
    return filter_rows(df, column, operator, value).agg(F.count("*").alias("matching_rows"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in an explicit order; the keys should leave no ties."""
    if not 1 <= n <= PREVIEW_LIMIT:
        raise OperationError(f"a preview shows 1 to {PREVIEW_LIMIT} rows, not {n}")
    require_columns(df, *order_by)
    return df.orderBy(*(quoted(name).asc_nulls_last() for name in order_by)).limit(n)
