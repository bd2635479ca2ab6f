"""Interval join: points with the intervals of their key that hold them.

Time is cut into buckets, coarser ones for longer intervals (each level doubles), so that an interval meets at most three buckets
of its level however long it is. A point looks into its bucket of each level that occurs. Candidates are joined by
key, level and bucket, and the exact condition decides. A bucket with more than ``SPLIT`` points is dealt into
parts and its intervals go to all of them, so no task gets a crowded bucket whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import quoted
from ledgerscope.operators.bands import position

SPLIT = 100_000
LEVELS = 64  # doublings of a bucket's width; more would pass any range of numbers


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: dict[str, str],
    at: str,
    ends: tuple[str, str],
    width: float,
    open_start: bool = False,
    split: int = SPLIT,
) -> DataFrame:
    """All columns of ``points`` beside those of ``intervals`` for each point within an interval of its key, ends included.

    ``keys`` maps columns of ``points`` to those of ``intervals``; with ``open_start`` the start itself is outside. ``width`` is that of the narrowest
    buckets, in microseconds for times, days for dates, else in the column's unit; it steers the work only. Rows with a null key, time or end match
    nothing, and neither do intervals that end before they start. Repeated rows match each by itself.
    """
    names = {name.lower() for name in points.columns}
    clashing = [name for name in intervals.columns if name.lower() in names]
    if clashing:
        raise ColumnError(f"columns are in both tables: {', '.join(clashing)}")
    if width <= 0:
        raise ColumnError("a bucket needs a width over 0")
    key_names = [f"key {i}" for i in range(len(keys))]

    def bucket(place: Column, level: Column) -> Column:
        return F.floor(place / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))

    start, stop = position(intervals, ends[0]), position(intervals, ends[1])
    spans = intervals.select(F.struct(*(quoted(c) for c in intervals.columns)).alias("interval"), *(quoted(k).alias(n) for k, n in zip(keys.values(), key_names)), start.alias("start"), stop.alias("stop"))
    spans = spans.where("start <= stop")
    need = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest((F.col("stop") - F.col("start")) / width, F.lit(1.0)))))
    spans = spans.withColumn("level", F.least(need, F.lit(LEVELS - 1)).cast("int"))
    levels = spans.agg(F.array_sort(F.collect_set("level"))).scalar()  # LEVELS at most
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start"), F.col("level")), bucket(F.col("stop"), F.col("level")))))

    dots = points.select(F.struct(*(quoted(c) for c in points.columns)).alias("point"), *(quoted(k).alias(n) for k, n in zip(keys, key_names)), position(points, at).alias("place"))
    for name in key_names:
        dots, spans = dots.where(f"`{name}` is not null"), spans.where(f"`{name}` is not null")
    dots = dots.where("place is not null").withColumn("level", F.explode(levels)).withColumn("bucket", bucket(F.col("place"), F.col("level")))

    group = [*key_names, "level", "bucket"]
    crowded = dots.groupBy(*(f"`{n}`" for n in group)).agg(F.count("*").alias("n")).where(F.col("n") > split)
    crowded = crowded.select(*(f"`{n}`" for n in group), F.ceil(F.col("n") / split).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dots = dots.join(crowded, group, "left").withColumn("part", F.pmod(F.xxhash64("point"), parts).cast("int")).drop("parts")
    spans = spans.join(crowded, group, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    inside = (F.col("place") > F.col("start")) if open_start else (F.col("place") >= F.col("start"))
    joined = dots.join(spans, [*group, "part"]).where(inside & (F.col("place") <= F.col("stop")))
    return joined.select("point.*", "interval.*")
