"""Exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.columns import quoted, require_columns


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def percent_change(value: Column, previous: Column) -> Column:
    """``(value / previous - 1) * 100``; null when the previous value is zero."""
    return (F.try_divide(value.cast("double"), previous.cast("double")) - 1) * 100


def measures(quantity: Column, unit_price: Column, discount: Column, cost_ratio: Column) -> dict[str, Column]:
    """Revenue, cost and profit of an order line, in cents-exact DECIMAL."""
    gross = quantity.cast("decimal(10,0)") * unit_price.cast("decimal(12,2)")
    revenue = F.round(gross * (1 - discount.cast("decimal(5,4)")), 2).cast("decimal(18,2)")
    cost = F.round(gross * cost_ratio.cast("decimal(5,4)"), 2).cast("decimal(18,2)")
    return {"revenue": revenue, "cost": cost, "profit": (revenue - cost).cast("decimal(18,2)")}


def one_per_key(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` with an error for a key that occurs more than once, so that a join adds no rows."""
    twice = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.coalesce(quoted(key).cast("string"), F.lit("null"))))
    return lookup.groupBy(quoted(key).alias(key)).agg(F.when(F.count("*") == 1, F.first(quoted(value))).otherwise(twice).alias(value))


def derive_financials(df: DataFrame, ratios: DataFrame, key: str) -> DataFrame:
    """Add revenue, cost and profit from quantity, unit price, discount and a lookup of cost ratios.

    ``ratios`` has ``key`` and ``cost_ratio``; a key that it holds twice is an error while the plan runs.
    """
    require_columns(df, key, "quantity", "unit_price", "discount")
    require_columns(ratios, key, "cost_ratio")
    joined = df.join(one_per_key(ratios, key, "cost_ratio"), key, "left")
    columns = measures(F.col("quantity"), F.col("unit_price"), F.col("discount"), F.col("cost_ratio"))
    return joined.withColumns(columns)
