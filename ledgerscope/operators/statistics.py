"""Global and grouped statistics of one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import OperationError
from ledgerscope.functions.columns import numeric, present, require_columns
from ledgerscope.functions.labels import GroupKey, group_key
from ledgerscope.functions.periods import period_filter
from ledgerscope.operators.change import period_change
from ledgerscope.operators.median import exact_median

STATISTICS = ("mean", "median", "sum", "min", "max", "std", "count")
GROUP_AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count")


def _checked(operation: str, allowed: Sequence[str]) -> str:
    word = operation.strip().lower()
    if word not in allowed:
        raise OperationError(f"unknown operation {operation!r}; use one of {', '.join(allowed)}")
    return word


def mean(value: Column, dtype: T.DataType) -> Column:
    """The mean as a double; decimals are summed exactly and rounded once."""
    if isinstance(dtype, T.DecimalType):
        return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
    return F.avg(value)


def _aggregate(operation: str, value: Column, dtype: T.DataType) -> Column:
    """Every statistic that map-side partial aggregation can compute."""
    if operation == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if operation == "mean":
        return mean(value, dtype)
    if operation == "std":
        return F.stddev_samp(value)
    return {"min": F.min, "max": F.max, "count": F.count}[operation](value)


def _summary(df: DataFrame, column: str, operations: Sequence[str], key: GroupKey | None) -> DataFrame:
    """Columns ``key`` (if grouped) and one per operation."""
    if set(operations) == {"count"}:
        require_columns(df, column)
        value = present(df, column)
    else:
        value = numeric(df, column)
    rows = df.select(*([key.column.alias("key")] if key else []), value.alias("value"))
    dtype = rows.schema["value"].dataType
    keys = ["key"] if key else []
    plain = [op for op in operations if op != "median"]
    partial = None
    if plain:
        aggregates = [_aggregate(op, F.col("value"), dtype).alias(op) for op in plain]
        partial = rows.groupBy(*keys).agg(*aggregates)
    if "median" not in operations:
        return partial
    medians = exact_median(rows, "value", keys, few_groups=key is None or key.calendar)
    if partial is None:
        return medians
    if key is None:
        return partial.withColumn("median", medians.scalar()).select(*operations)
    medians = medians.withColumnRenamed("key", "median_key")
    if key.calendar:
        medians = F.broadcast(medians)
    joined = partial.join(medians, F.col("key").eqNullSafe(F.col("median_key")), "left")
    return joined.select("key", *operations)


def summarize(
    df: DataFrame,
    column: str,
    operations: Sequence[str] = STATISTICS,
    group_by: str | None = None,
    time_col: str | None = None,
) -> DataFrame:
    """Several statistics of one column: one row, or one row per group in ascending order."""
    words = [_checked(op, STATISTICS) for op in operations]
    if group_by is None:
        return _summary(df, column, words, None)
    key = group_key(df, group_by, time_col)
    ordered = _summary(df, column, words, key).orderBy(F.col("key").asc_nulls_last())
    return ordered.select(key.label(F.col("key")).alias("group"), *words)


def statistics(
    df: DataFrame,
    operation: str,
    column: str,
    group_by: str | None = None,
    time_col: str | None = None,
) -> DataFrame:
    """One statistic: ``(value)``, or ``(group, value)`` in ascending group order.

    ``percentage_change`` needs ``group_by`` and gives ``(group, value,
    percentage_change)``.
    """
    word = _checked(operation, STATISTICS + ("percentage_change",))
    require_columns(df, column)
    if word == "percentage_change":
        if group_by is None:
            raise OperationError("percentage_change needs group_by")
        return period_change(df, column, group_by, time_col)
    return summarize(df, column, [word], group_by, time_col).withColumnRenamed(word, "value")


def group_aggregate(
    df: DataFrame,
    group_by: str,
    metric: str,
    aggregation: str = "sum",
    period: str | None = None,
    descending: bool = True,
    time_col: str | None = None,
    require_rows: bool = False,
) -> DataFrame:
    """``(group, value)`` sorted by value, nulls last, ties by group."""
    word = _checked(aggregation, GROUP_AGGREGATIONS)
    key = group_key(df, group_by, time_col)
    require_columns(df, metric)
    rows = period_filter(df, period, time_col, require_rows=require_rows)
    value = F.col(word)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    result = _summary(rows, metric, [word], key).orderBy(order, F.col("key").asc_nulls_last())
    return result.select(key.label(F.col("key")).alias("group"), value.alias("value"))


def rows_analyzed(df: DataFrame, period: str | None, time_col: str | None = None) -> Column:
    """The number of rows in a period, as a scalar to show beside a grouped result."""
    return period_filter(df, period, time_col).agg(F.count("*")).scalar()
