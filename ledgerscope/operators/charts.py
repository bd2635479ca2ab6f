"""Chart-ready series. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError, EmptyResultError, OperationError
from ledgerscope.functions.columns import is_numeric, quoted, require_columns
from ledgerscope.functions.labels import TIME_UNITS
from ledgerscope.functions.money import percent_of
from ledgerscope.functions.periods import period_filter
from ledgerscope.operators.statistics import GROUP_AGGREGATIONS, statistics

SERIES_TYPES = ("line", "bar", "pie")
POINT_LIMIT = 100


def chart_series(
    df: DataFrame,
    chart_type: str,
    x: str,
    y: str,
    aggregation: str = "sum",
    period: str | None = None,
    time_col: str | None = None,
    require_rows: bool = False,
) -> DataFrame:
    """Points ``(x, y)`` of a line, bar or pie chart, ordered by x.

    ``y`` must be numeric, even for a count. A pie adds each slice's ``percent``
    and fails on a negative slice.
    """
    kind, function = chart_type.strip().lower(), aggregation.strip().lower()
    if kind not in SERIES_TYPES:
        raise OperationError(f"unknown chart type {chart_type!r}; use one of {', '.join(SERIES_TYPES)} or chart_points")
    if function not in GROUP_AGGREGATIONS:
        raise OperationError(f"unknown aggregation {aggregation!r}; use one of {', '.join(GROUP_AGGREGATIONS)}")
    rows = period_filter(df, period, time_col, require_rows=require_rows)
    if not is_numeric(df, y):
        raise ColumnError(f"column {y} must be numeric")
    series = statistics(rows, function, y, x, time_col).select(F.col("group").alias("x"), F.col("value").alias("y"))
    if kind != "pie":
        return series
    total = series.agg(F.sum("y")).scalar()
    negative = F.raise_error(F.lit("a pie chart cannot show a negative slice")).cast(series.schema["y"].dataType)
    checked = series.withColumn("y", F.when(F.col("y") < 0, negative).otherwise(F.col("y")))
    return checked.withColumn("percent", percent_of(F.col("y"), total))


def scatter_points(
    df: DataFrame, x: str, y: str, period: str | None = None, time_col: str | None = None, require_rows: bool = False
) -> DataFrame:
    """All numeric pairs ``(x, y)`` without the rows that miss one of them."""
    if x.strip().lower() in TIME_UNITS:
        raise ColumnError("a scatter chart needs a numeric column as x")
    require_columns(df, x, y)
    if not is_numeric(df, x) or not is_numeric(df, y):
        raise ColumnError("a scatter chart needs numeric columns as x and y")
    points = period_filter(df, period, time_col).select(quoted(x).alias("x"), quoted(y).alias("y")).na.drop()
    if require_rows and points.isEmpty():
        raise EmptyResultError("no row has both a numeric x and a numeric y")
    return points


def chart_points(points: DataFrame, limit: int = POINT_LIMIT) -> DataFrame:
    """The first points in x order with the number of all points beside them."""
    if not 1 <= limit <= POINT_LIMIT:
        raise OperationError(f"a chart lists 1 to {POINT_LIMIT} points, not {limit}")
    total = points.agg(F.count("*")).scalar()
    ordered = points.orderBy(F.col("x").asc_nulls_last(), F.col("y").asc_nulls_last()).limit(limit)
    percent = ["percent"] if "percent" in points.columns else []
    return ordered.select(F.col("x").cast("string").alias("x"), "y", *percent, total.alias("points"))
