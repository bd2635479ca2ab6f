"""Subtotals over all combinations of grouping columns, from one read of the table.

Rows are summed at the finest level first (with the counted values as one more key), and all coarser levels are made
from that, so what is multiplied are groups, not rows. A group that holds most rows is one row a task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import numeric, quoted


def subtotals(df: DataFrame, by: list[str], sums: dict[str, str], distinct: tuple[str, str] | None = None, kind: str = "cube") -> DataFrame:
    """The ``by`` columns, ``level``, the ``sums`` (column: name), ``rows``, and the exact number of different values of ``distinct`` (column, name).

    ``level`` is the grouping id: bit i from the right is set where the column i from the right is totalled, which tells a total
    from a group whose key is null. ``kind`` is ``cube`` (all combinations) or ``rollup`` (each column below those before it). Sums of only
    missing values are null. An empty table gives the grand total alone.
    """
    if kind not in ("cube", "rollup"):
        raise ColumnError(f"unknown kind of subtotals: {kind}")
    if not by:
        raise ColumnError("subtotals need a column to group by")
    names = [*sums.values(), "rows", "level", *([distinct[1]] if distinct else [])]
    taken = {c.lower() for c in by}
    if len({n.lower() for n in names}) < len(names) or taken & {n.lower() for n in names}:
        raise ColumnError("names of results clash")
    keys = [quoted(c).alias(f"key {i}") for i, c in enumerate(by)]
    value = [quoted(distinct[0]).alias("value")] if distinct else []
    finest = df.groupBy(*keys, *value).agg(F.count("*").alias("n"), *(F.sum(numeric(df, c)).alias(f"sum {i}") for i, c in enumerate(sums)))
    groups = [F.col(f"key {i}") for i in range(len(by))]
    levels = finest.cube(*groups) if kind == "cube" else finest.rollup(*groups)
    totals = [F.sum(f"sum {i}").alias(name) for i, name in enumerate(sums.values())]
    if distinct:
        totals.append(F.count_distinct("value").alias(distinct[1]))
    found = levels.agg(F.grouping_id().alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *totals)
    return found.select(*(F.col(f"key {i}").alias(c) for i, c in enumerate(by)), *[n for n in found.columns if not n.startswith("key ")])
