"""Shares, margins, pivots, deviations and missing-value patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.columns import data_type, numeric, present, quoted, time_column
from ledgerscope.functions.labels import group_key
from ledgerscope.functions.money import percent_of
from ledgerscope.functions.periods import label_period, period_condition


def ratio_by(
    df: DataFrame, numerator: str, denominator: str, by: str, name: str = "ratio", time_col: str | None = None
) -> DataFrame:
    """Both sums per group and their ratio in percent, highest first. A ratio of sums, not a mean of ratios."""
    key = group_key(df, by, time_col)
    sums = df.groupBy(key.column.alias("__key")).agg(
        F.coalesce(F.sum(numeric(df, denominator)), F.lit(0)).alias("__below"),
        F.coalesce(F.sum(numeric(df, numerator)), F.lit(0)).alias("__above"),
    )
    return (
        sums.withColumn("__ratio", percent_of(F.col("__above"), F.col("__below")))
        .orderBy(F.col("__ratio").desc_nulls_last(), F.col("__key").asc_nulls_last())
        .select(
            key.label(F.col("__key")).alias("group"), F.col("__below").alias(denominator),
            F.col("__above").alias(numerator), F.col("__ratio").alias(name),
        )
    )


def share_of_total(df: DataFrame, metric: str, by: str, time_col: str | None = None) -> DataFrame:
    """Sum per group and its percent of the total, largest first.

    The total is a scalar subquery over the grouped sums, so no task sees all groups.
    """
    key = group_key(df, by, time_col)
    sums = df.groupBy(key.column.alias("key")).agg(F.coalesce(F.sum(numeric(df, metric)), F.lit(0)).alias("value"))
    total = sums.agg(F.sum("value")).scalar()
    return (
        sums.withColumn("share", percent_of(F.col("value"), total))
        .orderBy(F.col("value").desc_nulls_last(), F.col("key").asc_nulls_last())
        .select(key.label(F.col("key")).alias("group"), "value", "share")
    )


def pivot_sum(
    df: DataFrame, metric: str, by: str, across: str, values: Sequence[str], time_col: str | None = None
) -> DataFrame:
    """Sums with one row per group and one column per value of ``across``; no rows means 0.

    The values are given, so no job runs to find them, and only rows of given
    periods are read. Rows are first summed by both keys; these sums are then
    laid out as columns by their labels.
    """
    row_key, column_key = group_key(df, by, time_col), group_key(df, across, time_col)
    if column_key.unit:
        name = time_column(df, time_col)
        ranges = [
            period_condition(label_period(column_key.unit, value), quoted(name), data_type(df, name).simpleString())
            for value in values
        ]
        df = df.where(reduce(Column.__or__, ranges))
    cells = df.groupBy(row_key.column.alias("key"), column_key.column.alias("across")).agg(
        F.sum(numeric(df, metric)).alias("value")
    )
    labeled = cells.withColumn("across", column_key.label(F.col("across"))).where(F.col("across").isin(*values))
    sums = [
        F.coalesce(F.sum(F.when(F.col("across") == value, F.col("value"))), F.lit(0)).alias(value) for value in values
    ]
    table = labeled.groupBy("key").agg(*sums).orderBy(F.col("key").asc_nulls_last())
    return table.select(row_key.label(F.col("key")).alias("group"), *(quoted(value) for value in values))


def deviations(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose value lies at least ``threshold`` sample standard deviations from the mean.

    Mean and deviation come from one aggregate; a constant column has no deviations.
    """
    value = numeric(df, column)
    level = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
    distance = F.try_divide(value - level.getField("mean"), level.getField("std"))
    return df.withColumn("deviation", distance).where(F.abs(F.col("deviation")) >= threshold)


def missing_by(df: DataFrame, column: str, by: Sequence[str], time_col: str | None = None) -> DataFrame:
    """Rows and missing cells per group; ``by`` may mix columns and time words."""
    keys = {name: group_key(df, name, time_col) for name in by}
    inner = {name: F.col(f"__key{i}") for i, name in enumerate(keys)}
    counts = df.groupBy(*(key.column.alias(f"__key{i}") for i, key in enumerate(keys.values()))).agg(
        F.count("*").alias("__rows"), F.count_if(present(df, column).isNull()).alias("__missing")
    )
    ordered = counts.orderBy(*(column.asc_nulls_last() for column in inner.values()))
    labels = (key.label(inner[name]).alias(name) for name, key in keys.items())
    return ordered.select(*labels, F.col("__rows").alias("rows"), F.col("__missing").alias("missing"))
