"""Constraints on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.columns import present, quoted


def check_constraints(
    df: DataFrame, required: Sequence[str], key: str, not_null: Sequence[str], min_rows: int, max_rows: int,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows ``(constraint, violations, passed)``.

    All come from one grouping by key, merged before its shuffle: a key that
    holds much of the table is one row per task there. A constraint on a
    missing column is a violation of ``required columns`` and is left out.
    For a view of which ``df`` has only the checked columns, ``columns`` names all.
    """
    missing = [name for name in required if name not in (columns or df.columns)]
    checked = [name for name in not_null if name in df.columns]
    nulls = [F.count_if(present(df, name).isNull()).alias(f"nulls_{i}") for i, name in enumerate(checked)]
    keys = [quoted(key).alias("key")] if key in df.columns else []
    parts = df.groupBy(*keys).agg(F.count("*").alias("rows"), *nulls)
    total_nulls = [F.coalesce(F.sum(f"nulls_{i}"), F.lit(0)).alias(f"nulls_{i}") for i in range(len(checked))]
    totals = parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeated"),
        *total_nulls,
    )
    below = F.greatest(F.lit(min_rows) - F.col("rows"), F.lit(0))
    above = F.greatest(F.col("rows") - F.lit(max_rows), F.lit(0))
    results = [("required columns", F.lit(len(missing))), (f"rows between {min_rows} and {max_rows}", below + above)]
    if keys:
        results.append((f"unique {key}", F.col("repeated")))
    results += [(f"no missing {name}", F.col(f"nulls_{i}")) for i, name in enumerate(checked)]
    structs = [
        F.struct(F.lit(name).alias("constraint"), count.cast("bigint").alias("violations"), (count == 0).alias("passed"))
        for name, count in results
    ]
    return totals.select(F.inline(F.array(*structs)))
