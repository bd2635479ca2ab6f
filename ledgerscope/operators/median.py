"""Exact medians whose work does not gather a group in one task.

Spark's own exact percentile keeps every distinct value of a group in the
memory of one task. Here the values fall into bands, equal slices of their
logarithm, and rows are counted per group and band. Running
totals over these few counts show which band holds the middle rows. Only the
rows of that band are counted by value. These values are sliced once more,
evenly between the smallest and largest of them, so that values lying close
together are told apart too, and only those of the middle slice are put in order.

Nothing is sampled, and a lost task is recomputed to the same bands and slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.columns import quoted

BANDS = 32  # between neighbouring powers of two
SLICES = 1 << 17
MARKS = ("base", "low", "high", "lowest", "highest")
LOWEST_EXPONENT = 1075  # above that of the smallest positive double, 2**-1074


def value_band(name: str) -> Column:
    """A whole number that never falls while the value rises; null for null.

    The logarithm is the same on every machine and never falls either, so equal
    values always share a band and a higher value never has a lower one.
    """
    size = f"abs(CAST({name} AS DOUBLE))"
    return F.expr(f"""
        CASE WHEN {name} IS NULL THEN NULL
             ELSE CAST(sign({name}) AS BIGINT) * CASE
                 WHEN {size} = DOUBLE('Infinity') THEN 1L << 40
                 WHEN {size} > 0 THEN floor((log2({size}) + {LOWEST_EXPONENT}) * {BANDS})
                 ELSE 0L END
        END""")


def value_slice(name: str, lowest: str, highest: str) -> Column:
    """The even slice of a value between two doubles that enclose it; it never falls while the value rises."""
    place = f"(CAST({name} AS DOUBLE) - {lowest}) / ({highest} - {lowest})"
    return F.expr(f"CASE WHEN {highest} > {lowest} THEN floor({place} * {SLICES}) WHEN {name} IS NOT NULL THEN 0L END")


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """One row per group with the exact median of ``value``; null for a group without values.

    ``few_groups`` states that the number of groups has a bound that does not
    grow with the table. The bands found, two per group at most, are then
    broadcast to a second scan and the table is not shuffled. Otherwise rows are
    counted by group and value once, and both passes read those counts. As
    there are two passes, ``df`` must give the same rows each time: a table, or
    deterministic steps over one.
    """
    small = few_groups or not keys
    group = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(quoted(key).alias(name) for key, name in zip(keys, group)), quoted(value).alias("v"))
    counted = rows.withColumn("c", F.lit(1)) if small else rows.groupBy(*group, "v").agg(F.count("*").alias("c"))
    counted = counted.withColumn("c", F.when(F.col("v").isNull(), 0).otherwise(F.col("c")).cast("bigint"))

    banded = counted.withColumn("band", value_band("v"))
    middle = _in_bands(banded, _first_bands(banded, group), group, small)
    values = middle.groupBy(*group, *MARKS, "v").agg(F.sum("c").alias("c"))

    sliced = values.withColumn("band", value_slice("v", "lowest", "highest"))
    slices = sliced.groupBy(*group, *MARKS, "band").agg(F.sum("c").alias("c"))
    last = _in_bands(sliced.drop(*MARKS), _middle_bands(slices, group), group, small)

    ranked = _ranked(last, group, F.col("v"))
    lower = F.max(F.when(_covers("low"), F.col("v"))).cast("double")
    upper = F.max(F.when(_covers("high"), F.col("v"))).cast("double")
    found = ranked.groupBy(*group).agg(((lower + upper) / 2).alias("median"))
    return found.select(*(F.col(name).alias(key) for key, name in zip(keys, group)), "median")


def _covers(rank: str) -> Column:
    return (F.col("before") < F.col(rank)) & (F.col(rank) <= F.col("upto"))


def _ranked(rows: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Add how many values of the group lie before each row, and up to it."""
    rising = Window.partitionBy(*group).orderBy(order.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.col("base") + F.sum("c").over(rising))
    return upto.withColumn("before", F.col("upto") - F.col("c"))


def _first_bands(banded: DataFrame, group: list[str]) -> DataFrame:
    """The middle bands of each group; ``low`` and ``high`` are the 1-based middle ranks, equal for an odd count."""
    value = F.col("v").cast("double")
    bands = banded.groupBy(*group, "band").agg(
        F.sum("c").alias("c"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    n = F.sum("c").over(Window.partitionBy(*group))
    ranks = bands.withColumn("low", F.floor((n + 1) / 2)).withColumn("high", F.floor((n + 2) / 2))
    return _middle_bands(ranks.withColumn("base", F.lit(0).cast("bigint")), group)


def _middle_bands(bands: DataFrame, group: list[str]) -> DataFrame:
    """The one or two bands per group that hold the middle ranks, with all that is known of them together.

    ``base`` counts the values below; ``lowest`` and ``highest`` enclose those inside.
    """
    ranked = _ranked(bands, group, F.col("band"))
    held = ranked.where((F.col("before") < F.col("high")) & (F.col("low") <= F.col("upto")))
    whole = Window.partitionBy(*group)
    return held.select(
        *group, "band", "low", "high", F.min("before").over(whole).alias("base"),
        F.min("lowest").over(whole).alias("lowest"), F.max("highest").over(whole).alias("highest"),
    )


def _in_bands(rows: DataFrame, marks: DataFrame, group: list[str], small: bool) -> DataFrame:
    """The rows in the marked bands, with the ranks to look for; null keys and bands match."""
    marks = marks.select(*(F.col(name).alias(f"m_{name}") for name in [*group, "band"]), *MARKS)
    same = F.col("band").eqNullSafe(F.col("m_band"))
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"m_{name}"))
    joined = rows.join(F.broadcast(marks) if small else marks, same)
    return joined.drop(*(f"m_{name}" for name in [*group, "band"]))
