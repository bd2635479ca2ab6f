"""Scans, filters and periods."""

from pyspark.sql import functions as F

from ledgerscope.functions.periods import distinct_periods, latest_periods, period_filter
from ledgerscope.operators.filters import condition, filter_rows, preview
from ledgerscope.sources.dates import promote_dates
from ledgerscope.sources.star import read_table, sales
from workload.registry import doubles, register, with_sales

FILTER_COLUMNS = ("order_id", "order_date", "product", "category", "quantity", "discount", "revenue")
FILTER_SELECT = (
    "SELECT order_id, order_date, product, category, quantity, discount, CAST(revenue AS DOUBLE) AS revenue FROM sales WHERE "
)


@register("scan_sales", with_sales("""
SELECT order_id, order_date, customer_id, product, category, region, quantity, unit_price, discount,
       CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, CAST(profit AS DOUBLE) AS profit, salesperson
FROM sales"""))
def scan_sales(spark, sf_dir):
    return doubles(sales(spark, sf_dir), "revenue", "cost", "profit")


@register("promote_dates", """
SELECT o_orderkey AS order_key, CAST(o_orderdate AS TIMESTAMP) AS order_date,
       CASE WHEN o_orderkey % 1000 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
       CAST(o_orderdate AS TIMESTAMP) AS entry_time, strftime(o_orderdate, '%Y-%m-%d') AS label
FROM orders""")
def promote(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("order_date"),
        F.when(F.col("o_orderkey") % 1000 == 0, "unknown").otherwise(day).alias("due_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("entry_time"),
        day.alias("label"),
    )
    return promote_dates(text)


def _register_filter(name: str, column: str, operator: str, value, where: str) -> None:
    @register(name, with_sales(FILTER_SELECT + where))
    def build(spark, sf_dir):
        return doubles(filter_rows(sales(spark, sf_dir, *FILTER_COLUMNS), column, operator, value), "revenue")


_register_filter("filter_equals", "category", "equals", "PROMO", "category = 'PROMO'")
_register_filter("filter_not_equals", "discount", "not_equals", 0.05, "discount IS DISTINCT FROM 0.05")
_register_filter("filter_gt", "quantity", "greater_than", 45, "quantity > 45")
_register_filter("filter_gte", "quantity", "greater_than_or_equal", 45, "quantity >= 45")
_register_filter("filter_lt", "quantity", "less_than", 5, "quantity < 5")
_register_filter("filter_lte", "quantity", "less_than_or_equal", 5, "quantity <= 5")
_register_filter("filter_contains", "product", "contains", "AN.IL|ring$", "regexp_matches(product, 'AN.IL|ring$', 'i')")
_register_filter("filter_contains_date", "order_date", "contains", "-06-1\\d$", "strftime(order_date, '%m-%d') LIKE '06-1%' AND order_date = date_trunc('day', order_date)")
_register_filter("filter_contains_decimal", "revenue", "contains", "^\\d+[.]5$", "(revenue * 10000) % 10000 = 5000")
_register_filter("filter_date_from", "order_date", "greater_than_or_equal", "2000-06", "order_date >= TIMESTAMP '2000-06-01'")

COUNTED = {
    "equals": ("category", "equals", "PROMO"),
    "not_equals": ("discount", "not_equals", 0.05),
    "greater_than": ("quantity", "greater_than", 45),
    "greater_than_or_equal": ("quantity", "greater_than_or_equal", 45),
    "less_than": ("revenue", "less_than", 5000.5),
    "less_than_or_equal": ("order_date", "less_than_or_equal", "1997-12-31"),
    "contains": ("product", "contains", "bolt"),
    "equals_other_kind": ("quantity", "equals", "45"),
}


@register("filter_match_counts", with_sales("""
SELECT count(*) FILTER (WHERE category = 'PROMO') AS equals,
       count(*) FILTER (WHERE discount IS DISTINCT FROM 0.05) AS not_equals,
       count(*) FILTER (WHERE quantity > 45) AS greater_than,
       count(*) FILTER (WHERE quantity >= 45) AS greater_than_or_equal,
       count(*) FILTER (WHERE revenue < 5000.5) AS less_than,
       count(*) FILTER (WHERE order_date <= TIMESTAMP '1997-12-31') AS less_than_or_equal,
       count(*) FILTER (WHERE regexp_matches(product, 'bolt', 'i')) AS contains,
       CAST(0 AS BIGINT) AS equals_other_kind
FROM sales"""))
def filter_match_counts(spark, sf_dir):
    df = sales(spark, sf_dir, *FILTER_COLUMNS)
    return df.agg(*(F.count_if(condition(df, *request)).alias(name) for name, request in COUNTED.items()))


@register("filter_preview", with_sales("""
SELECT order_id, product, category, quantity, CAST(revenue AS DOUBLE) AS revenue, salesperson,
       (SELECT count(*) FROM sales WHERE quantity > 45) AS matching_rows
FROM sales WHERE quantity > 45
ORDER BY order_id NULLS LAST, revenue NULLS LAST, product NULLS LAST, category NULLS LAST, quantity NULLS LAST, salesperson NULLS LAST
LIMIT 20"""))
def filter_preview(spark, sf_dir):
    shown = ("order_id", "revenue", "product", "category", "quantity", "salesperson")
    matching = filter_rows(sales(spark, sf_dir, *shown), "quantity", "greater_than", 45)
    total = filter_rows(sales(spark, sf_dir, "quantity"), "quantity", "greater_than", 45).agg(F.count("*")).scalar()
    return doubles(preview(matching, shown, 20).withColumn("matching_rows", total), "revenue")


def _register_period(name: str, period: str, where: str) -> None:
    @register(name, with_sales("SELECT order_id, order_date, CAST(revenue AS DOUBLE) AS revenue FROM sales WHERE " + where))
    def build(spark, sf_dir):
        return doubles(period_filter(sales(spark, sf_dir, "order_id", "order_date", "revenue"), period), "revenue")


_register_period("period_year", "2000", "year(order_date) = 2000")
_register_period("period_month", "2000-09", "strftime(order_date, '%Y-%m') = '2000-09'")
_register_period("period_month_name", "September", "month(order_date) = 9")
_register_period("period_named_month_year", "September 2000", "strftime(order_date, '%Y-%m') = '2000-09'")
_register_period("period_compact_date", "19991215", "strftime(order_date, '%Y-%m') = '1999-12'")
_register_period("period_blank", " ", "TRUE")
_register_period("period_date_month", "1999-12-15", "strftime(order_date, '%Y-%m') = '1999-12'")


@register("periods", with_sales("""
SELECT strftime(order_date, '%Y-%m') AS period, count(*) AS rows FROM sales WHERE order_date IS NOT NULL GROUP BY 1"""))
def periods(spark, sf_dir):
    return distinct_periods(sales(spark, sf_dir, "order_date"))


@register("latest_two_periods", with_sales("""
SELECT strftime(order_date, '%Y-%m') AS period, count(*) AS rows FROM sales WHERE order_date IS NOT NULL
GROUP BY 1 ORDER BY 1 DESC LIMIT 2"""))
def latest_two_periods(spark, sf_dir):
    return latest_periods(sales(spark, sf_dir, "order_date"), 2)
