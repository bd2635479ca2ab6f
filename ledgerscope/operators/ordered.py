"""Running totals, moving averages and exact ranks over a whole table.

Rows are put in order by range partitions and written once with their number in order. Each range is then
summed by itself, and takes what the ranges before it add up to; there is one row for each range and key. So no task
gets more than its range, whatever keys or ties the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import quoted
from ledgerscope.sources.scratch import stored


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in order with ``in order``, a rising number; its upper bits name the range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("in order", F.monotonically_increasing_id())).withColumn("range", F.shiftright("in order", 33))


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], by: list[str] | None = None, number: str | None = None) -> DataFrame:
    """``df`` with the sums of columns up to and with each row, in the order of ``order``, nulls first.

    ``totals`` maps columns to the names of their running sums (null counts as 0); with ``by`` each group is summed by itself;
    ``number`` names a column for the row's number, from 1. Rows that are equal in ``order`` stand in the order of all their
    columns, so the result is the same on each run. Decimals and whole numbers are summed exactly, doubles in an order that may vary.
    """
    by = by or []
    _check_new(df, [*totals.values(), *([number] if number else [])])
    rest = [c for c in df.columns if c not in [*by, *order]]
    ranged = _ranged(df, [quoted(c).asc_nulls_first() for c in [*by, *order, *rest]])
    group = [*(quoted(c) for c in by), F.col("range")]
    sums = {f"sum {i}": F.sum(F.coalesce(quoted(c), F.lit(0))) for i, c in enumerate(totals)} | {"rows": F.count("*")}
    of_range = ranged.groupBy(*group).agg(*(value.alias(name) for name, value in sums.items()))
    earlier = Window.partitionBy(*(quoted(c) for c in by)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = of_range.select(
        *(quoted(c).alias(f"by {i}") for i, c in enumerate(by)), F.col("range").alias("of range"),
        *(F.coalesce(F.sum(f"`{name}`").over(earlier), F.lit(0)).alias(f"before {name}") for name in sums),
    )
    inner = Window.partitionBy(*group).orderBy("in order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({name: value.over(inner) for name, value in sums.items()})
    same = F.col("range") == F.col("of range")
    for i, c in enumerate(by):
        same &= quoted(c).eqNullSafe(F.col(f"by {i}"))
    joined = summed.join(before, same)
    out = [(F.col(f"`sum {i}`") + F.col(f"`before sum {i}`")).alias(name) for i, name in enumerate(totals.values())]
    if number:
        out.append((F.col("rows") + F.col("before rows")).alias(number))
    return joined.select(*(quoted(c) for c in df.columns), *out)


def moving_average(df: DataFrame, order: list[str], column: str, width: int, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the mean of ``column`` over the last ``width`` rows up to each row; nulls do not count, and the mean of none is null.

    The sum of a frame is a difference of two running sums, so a frame may cross any number of ranges. The sums are exact for decimals and whole numbers.
    """
    if width < 1:
        raise ColumnError("a frame needs a row")
    by = by or []
    _check_new(df, [name])
    filled = df.withColumn("filled", quoted(column).isNotNull().cast("long"))
    summed = stored(running_totals(filled, order, {column: "total", "filled": "values"}, by, "row number"))
    back = summed.select(
        *(quoted(c).alias(f"by {i}") for i, c in enumerate(by)),
        (F.col("row number") + width).alias("at number"), F.col("total").alias("old total"), F.col("values").alias("old values"),
    )
    same = F.col("row number") == F.col("at number")
    for i, c in enumerate(by):
        same &= quoted(c).eqNullSafe(F.col(f"by {i}"))
    joined = summed.join(back, same, "left")
    count = F.col("values") - F.coalesce("old values", F.lit(0))
    mean = F.when(count > 0, (F.col("total") - F.coalesce("old total", F.lit(0))).cast("double") / count)
    return joined.select(*(quoted(c) for c in df.columns), mean.alias(name))


def ranks(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """``df`` with ``rank``, ``dense_rank`` and ``percent_rank`` of ``column`` over the whole table; nulls come last.

    A rank belongs to a value, so rows are counted by value first and the values, which have no ties, are put in order; equal values
    cannot lie on two sides of a range's border. A value that many rows share is one row until the ranks go back to the rows, and there
    adaptive execution splits it.
    """
    _check_new(df, ["rank", "dense_rank", "percent_rank"])
    values = df.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n"))
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    ranged = _ranged(values, [order])
    of_range = ranged.groupBy("range").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = of_range.select(
        F.col("range").alias("of range"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows before"),
        F.coalesce(F.sum("values").over(earlier), F.lit(0)).alias("values before"),
    )
    inner = Window.partitionBy("range").orderBy("in order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = of_range.agg(F.sum("rows")).scalar()
    placed = ranged.withColumns({"upto": F.sum("n").over(inner), "number": F.count("*").over(inner)}).join(before, F.col("range") == F.col("of range"))
    rank = F.col("rows before") + F.col("upto") - F.col("n") + 1
    ranked = placed.select(
        "value",
        rank.alias("rank"),
        (F.col("values before") + F.col("number")).alias("dense_rank"),
        F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
    )
    return df.join(ranked, quoted(column).eqNullSafe(F.col("value"))).drop("value")


def top_rows(df: DataFrame, by: str, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each group with ``place``, their number; ties are broken by all columns.

    Each task keeps the first rows of its groups before the shuffle, so a group that holds most of the table sends ``count`` rows a task.
    """
    _check_new(df, ["place"])
    first = Window.partitionBy(quoted(by)).orderBy(*order, *(quoted(c) for c in df.columns))
    return df.withColumn("place", F.row_number().over(first)).where(F.col("place") <= count)


def _check_new(df: DataFrame, names: list[str]) -> None:
    taken = {c.lower() for c in df.columns}
    clashing = [name for name in names if name.lower() in taken]
    if clashing:
        raise ColumnError(f"columns are there already: {', '.join(clashing)}")
