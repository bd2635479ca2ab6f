"""Keyed corrections of a sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.columns import quoted, require_columns
from ledgerscope.functions.money import measures, one_per_key


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Replace the quantity of the listed keys and recompute the measures of those rows.

    ``overrides`` has ``key`` and ``quantity``, and a key that it holds twice is an
    error while the plan runs; ``df`` also has the ``cost_ratio`` of each row. Rows not listed keep their measures.
    """
    require_columns(df, key, "quantity", "unit_price", "discount", "cost_ratio", "revenue", "cost", "profit")
    require_columns(overrides, key, "quantity")
    listed = one_per_key(overrides, key, "quantity").select(quoted(key).alias("__key"), F.col("quantity").alias("__quantity"))
    joined = df.join(listed, quoted(key) == F.col("__key"), "left")
    new = measures(F.col("__quantity"), F.col("unit_price"), F.col("discount"), F.col("cost_ratio"))
    is_listed = F.col("__quantity").isNotNull()
    updated = {name: F.when(is_listed, value).otherwise(F.col(name)) for name, value in new.items()}
    updated["quantity"] = F.coalesce(F.col("__quantity"), F.col("quantity"))
    return joined.withColumns(updated).select(*(quoted(name) for name in df.columns))
