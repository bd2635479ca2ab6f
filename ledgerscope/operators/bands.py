"""Bands of an ordered column, so that work in order can be split by key and time.

The range of the column is cut into ``SLICES`` even slices, rows are counted by slice, and slices are put
together in order until a band has ``rows`` rows. So a band is a range of values with about ``rows`` rows
over all keys, also where one key has most of them; only a slice that is fuller by itself makes a larger one. The
table of slices has a fixed size and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import ColumnError

SLICES = 65_536
ROWS = 1_000_000


def position(df: DataFrame, name: str) -> Column:
    """A double that rises with the column: microseconds, days, or the number itself."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise ColumnError(f"{name} has no order by time or number")


def banded(frames: list[tuple[DataFrame, str]], rows: int = ROWS) -> list[DataFrame]:
    """Each frame with ``band``, a whole number that rises with its column; the bands are the same in all frames.

    Null is the lowest band, NaN the highest.
    """
    places = [(df.withColumn("band position", position(df, name))) for df, name in frames]
    all_places = reduce(DataFrame.union, [df.select("band position") for df in places])
    at = F.col("band position")
    finite = ~F.isnan(at) & (F.abs(at) < float("inf"))
    ends = all_places.where(finite).agg(F.struct(F.min(at).alias("low"), F.max(at).alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    part = F.when(high > low, (at - low) / (high - low) * SLICES)
    inside = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(F.coalesce(part, F.lit(0.0)))))
    slice_of = F.when(at.isNull(), F.lit(-1)).when(F.isnan(at), F.lit(SLICES)).when(at == float("inf"), F.lit(SLICES - 1)).when(at == float("-inf"), F.lit(0)).otherwise(inside)
    counts = all_places.groupBy(slice_of.cast("int").alias("band slice")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("band slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")  # SLICES + 2 rows at most
    table = counts.select(F.col("band slice").alias("of slice"), F.floor(before / rows).cast("long").alias("band"))
    sliced = [df.withColumn("band slice", slice_of.cast("int")) for df in places]
    joined = [df.join(F.broadcast(table), F.col("band slice") == F.col("of slice")) for df in sliced]
    return [out.select(*(f"`{c}`" for c in df.columns), "band") for out, (df, _) in zip(joined, frames)]
