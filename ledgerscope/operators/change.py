"""Change from one period, or one group, to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.columns import numeric, quoted, time_column
from ledgerscope.functions.labels import GroupKey, group_key, period_start
from ledgerscope.functions.money import percent_change, percent_of

BANDS = 65_536


def period_change(df: DataFrame, column: str, group_by: str, time_col: str | None = None) -> DataFrame:
    """Sum per group and its change against the previous group that occurs, in ascending order."""
    key = group_key(df, group_by, time_col)
    sums = df.groupBy(key.column.alias("key")).agg(F.coalesce(F.sum(numeric(df, column)), F.lit(0)).alias("value"))
    lagged = _with_previous(sums, key)
    return lagged.orderBy(F.col("key").asc_nulls_last()).select(
        key.label(F.col("key")).alias("group"),
        "value",
        percent_change(F.col("value"), F.col("previous")).alias("percentage_change"),
    )


def _with_previous(sums: DataFrame, key: GroupKey) -> DataFrame:
    """Add the value of the previous key.

    Time labels are few, so one task orders them. Any other key may have as many groups as the table has
    rows: they are cut into bands in key order, each band is lagged by itself, and its first key takes
    the last value of the band before.
    """
    rising = F.col("key").asc_nulls_last()
    if key.calendar:
        return sums.withColumn("previous", F.lag("value").over(Window.orderBy(rising)))

    banded = sums.withColumn("band", _band(sums))
    edges = banded.groupBy("band").agg(F.max_by("value", "key").alias("last_value"))
    in_order = Window.orderBy(F.col("band").asc_nulls_last())  # one row per band
    carried = edges.select(F.col("band").alias("of_band"), F.lag("last_value").over(in_order).alias("carried"))
    within = Window.partitionBy("band").orderBy(rising)
    lagged = banded.withColumn("place", F.row_number().over(within)).withColumn("inside", F.lag("value").over(within))
    previous = F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("inside"))
    return lagged.join(carried, F.col("band").eqNullSafe(F.col("of_band")), "left").select("key", "value", previous.alias("previous"))


def _band(sums: DataFrame) -> Column:
    """A band that rises with the key: even steps of numbers and times, three characters behind the common start of texts."""
    dtype, key = sums.schema["key"].dataType, F.col("key")
    low_high = lambda value: sums.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if isinstance(dtype, T.StringType):
        shorter = F.least(F.length("low"), F.length("high"))
        places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
        same = F.filter(places, lambda i: F.substr(F.col("low"), F.lit(1), i) == F.substr(F.col("high"), F.lit(1), i))
        common = low_high(key).select(F.size(same)).scalar()
        return F.when(key.isNotNull(), F.substr(key, common + 1, F.lit(3)))
    if isinstance(dtype, T.DateType):
        value = F.unix_date(key).cast("double")
    elif isinstance(dtype, T.TimestampNTZType):
        value = key.cast("timestamp").cast("double")
    elif isinstance(dtype, (T.NumericType, T.TimestampType)):
        value = key.cast("double")
    else:
        return F.when(key.isNotNull(), F.lit(0))
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    ends = low_high(finite).select(F.struct("low", "high")).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    step = F.coalesce(F.floor(F.try_divide(finite - low, high - low) * (BANDS - 1)), F.lit(0))
    return F.when(key.isNotNull(), F.when(finite.isNotNull(), step).when(value < 0, F.lit(-1)).otherwise(F.lit(BANDS)))


def period_sums(df: DataFrame, metric: str, by: str, unit: str = "month", time_col: str | None = None) -> DataFrame:
    """``(start, key, value)``: the sum of a metric per period and group. Rows without a time are left out."""
    ts = quoted(time_column(df, time_col))
    key = group_key(df, by, time_col)
    return (
        df.where(ts.isNotNull())
        .groupBy(period_start(unit, ts).alias("start"), key.column.alias("key"))
        .agg(F.coalesce(F.sum(numeric(df, metric)), F.lit(0)).alias("value"))
    )


def compare_sums(sums: DataFrame, label: Callable[[Column], Column]) -> DataFrame:
    """The two latest periods of :func:`period_sums` side by side, largest decline first; no row means 0."""
    starts = sums.select("start").distinct()
    latest = starts.agg(F.max("start")).scalar()
    previous = starts.orderBy(F.desc("start")).limit(2).agg(F.when(F.count("*") == 2, F.min("start"))).scalar()

    def part(start: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("start") == start, F.col("value"))), F.lit(0))

    recent = sums.where(F.col("start") >= previous)
    both = recent.groupBy("key").agg(part(previous).alias("previous_value"), part(latest).alias("latest_value"))
    return (
        both.withColumn("change", F.col("latest_value") - F.col("previous_value"))
        .orderBy(F.col("change"), F.col("key").asc_nulls_last())
        .select(
            label(F.col("key")).alias("group"), "previous_value", "latest_value", "change",
            percent_of(F.col("change"), F.col("previous_value")).alias("percentage_change"),
        )
    )


def compare_periods(
    df: DataFrame, metric: str, by: str, unit: str = "month", time_col: str | None = None
) -> DataFrame:
    """Sum of a metric per group in the two latest periods, largest decline first.

    The table is read once: sums per period and group tell the latest periods as
    well. A group missing from one period counts as 0 there.
    """
    return compare_sums(period_sums(df, metric, by, unit, time_col), group_key(df, by, time_col).label)


def largest_decline(
    df: DataFrame, metric: str, by: str, unit: str = "month", time_col: str | None = None
) -> DataFrame:
    """The group whose metric fell most between the two latest periods."""
    return compare_periods(df, metric, by, unit, time_col).limit(1)
