"""What changed between two snapshots of a table, by key.

Rows are compared as a multiset: 128 bits stand for a row, and equal rows of a key are counted in both snapshots. Only keys and hashes are
shuffled. The columns that changed come from sums of column hashes, plus for the new and minus for the old rows, which cancel where the values
of a column are the same ones; they are added up before the shuffle, so a key with most of the rows costs one row a task for each of its versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import quoted


def snapshot_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``change`` (added, removed or changed), ``rows_added``, ``rows_removed`` and ``changed_columns`` of each key that differs.

    A key is changed if it has rows in both snapshots. Null keys are equal to each other; repeated rows count as often as they are
    there. ``changed_columns`` lists, in the order of the table, the columns whose values differ for a changed key with as many rows
    as before; else it is empty, as then every column has more or fewer values. Both snapshots have the same columns.
    """
    if old.columns != new.columns:
        raise ColumnError("the snapshots have different columns")
    missing = [k for k in keys if k not in old.columns]
    if missing:
        raise ColumnError(f"no such column: {', '.join(missing)}")
    values = [c for c in old.columns if c not in keys]

    def hashed(salt: int, column: str) -> Column:
        """A null counts as a value of its own; the names keep values of two columns apart."""
        return F.xxhash64(F.lit(salt), F.lit(column), quoted(column).isNull(), quoted(column))

    def signed(df: DataFrame, sign: int) -> DataFrame:
        parts = [F.array(*(hashed(salt, c) for c in values)).alias(f"hashes {salt}") for salt in (1, 2)]
        return df.select(*(quoted(k).alias(f"key {i}") for i, k in enumerate(keys)), *parts, F.lit(sign).alias("sign"))

    both = signed(old, -1).union(signed(new, 1))
    group = [F.col(f"key {i}") for i in range(len(keys))]
    versions = both.groupBy(*group, "hashes 1", "hashes 2").agg(F.sum("sign").alias("more"), F.max(F.col("sign") == -1).alias("in old"), F.max(F.col("sign") == 1).alias("in new"))
    more = F.col("more").cast("decimal(38,0)")
    moved = [F.sum(more * F.col("hashes 1")[i].cast("decimal(20,0)")).alias(f"moved {i}") for i in range(len(values))]
    by_key = versions.groupBy(*group).agg(
        F.sum(F.greatest("more", F.lit(0))).alias("rows_added"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("rows_removed"),
        F.max("in old").alias("in old"), F.max("in new").alias("in new"), *moved,
        F.sum("more").alias("net"),
    )
    differing = by_key.where((F.col("rows_added") > 0) | (F.col("rows_removed") > 0))
    change = F.when(~F.col("in old"), "added").when(~F.col("in new"), "removed").otherwise("changed")
    names = F.filter(F.array(*(F.when(F.col(f"moved {i}") != 0, F.lit(c)) for i, c in enumerate(values)), F.lit(None).cast("string")), lambda c: c.isNotNull())
    listed = F.when((change == "changed") & (F.col("net") == 0), F.array_join(names, ",")).otherwise("")
    return differing.select(*(F.col(f"key {i}").alias(k) for i, k in enumerate(keys)), change.alias("change"), "rows_added", "rows_removed", listed.alias("changed_columns"))
