"""The five business questions, each a one-row or ordered result.

``table`` gives the sales table with the columns asked for, for example
``lambda *names: df.select(*names)``; a view over several tables can then leave
out the joins that a question does not need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.labels import time_label
from ledgerscope.functions.money import percent_change
from ledgerscope.operators.change import compare_sums, period_sums
from ledgerscope.operators.shares import ratio_by
from ledgerscope.operators.statistics import group_aggregate

Table = Callable[..., DataFrame]

QUESTIONS = {
    "q1": "Why did sales decrease last month?",
    "q2": "Which category generated the most revenue?",
    "q3": "Which region has the highest profit margin?",
    "q4": "Are there any unusual sales patterns?",
    "q5": "Give me a management summary of the dataset.",
}


def latest_change(sums: DataFrame) -> DataFrame:
    """The latest month with its change, beside the month before it, from sums per month and group."""
    monthly = sums.groupBy("start").agg(F.sum("value").alias("value"))
    in_time = Window.orderBy("start")  # one row per month
    before, month = F.lag("value").over(in_time), lambda start: time_label("month", start)
    return (
        monthly.select(
            month(F.lag("start").over(in_time)).alias("previous_month"),
            before.alias("previous_value"),
            month(F.col("start")).alias("latest_month"),
            F.col("value").alias("latest_value"),
            percent_change(F.col("value"), before).alias("percentage_change"),
        )
        .orderBy(F.desc("latest_month"))
        .limit(1)
    )


def sales_decrease(table: Table) -> DataFrame:
    """Q1: the latest monthly change and the category that declined most."""
    sums = period_sums(table("order_date", "category", "revenue"), "revenue", "category")
    decline = compare_sums(sums, lambda key: key.cast("string")).limit(1)
    worst = decline.select(F.struct("group", "change", "percentage_change")).scalar()
    return latest_change(sums).select(
        "*",
        worst.getField("group").alias("largest_decline"),
        worst.getField("change").alias("largest_decline_change"),
        worst.getField("percentage_change").alias("largest_decline_percentage_change"),
    )


def top_category(table: Table) -> DataFrame:
    """Q2: the category with the most revenue."""
    ranked = group_aggregate(table("category", "revenue"), "category", "revenue", "sum")
    return ranked.limit(1).select(F.col("group").alias("category"), F.col("value").alias("revenue"))


def region_margins(table: Table) -> DataFrame:
    """Q3: revenue, profit and margin by region, best margin first."""
    margins = ratio_by(table("region", "revenue", "profit"), "profit", "revenue", "region", name="profit_margin")
    return margins.withColumnRenamed("group", "region")


def large_orders(table: Table, threshold: float) -> DataFrame:
    """Orders above a quantity, largest first."""
    names = ("order_id", "order_date", "product", "category", "region", "quantity", "revenue")
    return table(*names).where(F.col("quantity") > threshold).orderBy(F.desc("quantity"), "order_id", "revenue", "product")


def unusual_patterns(table: Table, threshold: float) -> DataFrame:
    """Q4: number and size of large orders, and missing discounts, in one pass."""
    large = F.col("quantity") > threshold
    return table("quantity", "discount").agg(
        F.count_if(large).alias("large_orders"),
        F.max(F.when(large, F.col("quantity"))).alias("largest_quantity"),
        F.count_if(F.col("discount").isNull()).alias("missing_discounts"),
    )


def kpi_totals(table: Table) -> DataFrame:
    """Several totals in one row."""
    return table("quantity", "revenue", "cost", "profit").agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_quantity"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost"),
        F.coalesce(F.sum("profit"), F.lit(0)).alias("total_profit"),
    )


def management_summary(table: Table, column_count: int) -> DataFrame:
    """Q5: size, totals, top category, latest change and missing discounts."""
    rows = table("order_date", "category", "revenue", "profit", "discount")
    top = top_category(lambda *names: rows.select(*names)).select("category").scalar()
    latest = latest_change(period_sums(rows, "revenue", "category")).select(F.struct("latest_month", "percentage_change")).scalar()
    totals = rows.agg(
        F.count("*").alias("rows"),
        F.lit(column_count).cast("bigint").alias("columns"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"),
        F.coalesce(F.sum("profit"), F.lit(0)).alias("total_profit"),
        F.count_if(F.col("discount").isNull()).alias("missing_discounts"),
    )
    return totals.select(
        "*",
        top.alias("top_category"),
        latest.getField("latest_month").alias("latest_month"),
        latest.getField("percentage_change").alias("latest_change"),
    )
