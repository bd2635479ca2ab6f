"""Statistics, group aggregates, changes, comparisons, shares and charts."""

from pyspark.sql import functions as F

from ledgerscope.operators.change import compare_periods, largest_decline, period_change
from ledgerscope.operators.charts import chart_points, chart_series, scatter_points
from ledgerscope.operators.filters import filter_rows
from ledgerscope.operators.shares import deviations, missing_by, pivot_sum, share_of_total
from ledgerscope.operators.statistics import STATISTICS, group_aggregate, rows_analyzed, statistics, summarize
from ledgerscope.sources.star import sales
from workload.registry import doubles, register, with_sales

LABELS = {
    "month": "strftime(order_date, '%Y-%m')",
    "quarter": "concat(strftime(order_date, '%Y'), 'Q', quarter(order_date))",
    "year": "strftime(order_date, '%Y')",
}


def _sql_statistic(operation: str, column: str, exact: bool) -> str:
    """SQL of one statistic; ``exact`` marks DECIMAL columns."""
    return {
        "mean": f"CAST(sum({column}) AS DOUBLE) / count({column})" if exact else f"round(avg({column}), 6)",
        "median": f"round(median(CAST({column} AS DOUBLE)), 6)",
        "sum": f"CAST(coalesce(sum({column}), 0) AS DOUBLE)",
        "min": f"CAST(min({column}) AS DOUBLE)",
        "max": f"CAST(max({column}) AS DOUBLE)",
        "std": f"round(stddev_samp(CAST({column} AS DOUBLE)), 6)",
        "count": f"count({column})",
    }[operation]


def _rounded(df, operation: str, name: str, exact: bool = True):
    """The same numbers as ``_sql_statistic`` for a result column."""
    if operation in ("median", "std") or (operation == "mean" and not exact):
        return df.withColumn(name, F.round(F.col(name), 6))
    return df if operation == "count" else doubles(df, name)


@register("stat_global", with_sales(
    "SELECT " + ", ".join(f"{_sql_statistic(op, 'revenue', True)} AS {op}" for op in STATISTICS) + " FROM sales"))
def stat_global(spark, sf_dir):
    result = summarize(sales(spark, sf_dir, "revenue"), "revenue")
    for operation in STATISTICS:
        result = _rounded(result, operation, operation)
    return result


def _register_statistic(operation: str, column: str, by: str, exact: bool) -> None:
    sql = f'SELECT {by} AS "group", {_sql_statistic(operation, column, exact)} AS value FROM sales GROUP BY 1'

    @register(f"stat_by_{operation}", with_sales(sql))
    def build(spark, sf_dir):
        result = statistics(sales(spark, sf_dir, by, column), operation, column, by)
        return _rounded(result, operation, "value", exact)


_register_statistic("mean", "revenue", "salesperson", True)
_register_statistic("median", "revenue", "salesperson", True)
_register_statistic("sum", "revenue", "salesperson", True)
_register_statistic("min", "unit_price", "category", False)
_register_statistic("max", "unit_price", "category", False)
_register_statistic("std", "profit", "salesperson", True)
_register_statistic("count", "discount", "region", False)


def _register_by_time(unit: str) -> None:
    parts = ", ".join(f"{_sql_statistic(op, 'profit', True)} AS {op}" for op in STATISTICS)

    @register(f"stat_by_{unit}", with_sales(f'SELECT {LABELS[unit]} AS "group", {parts} FROM sales GROUP BY 1'))
    def build(spark, sf_dir):
        result = summarize(sales(spark, sf_dir, "order_date", "profit"), "profit", group_by=unit)
        for operation in STATISTICS:
            result = _rounded(result, operation, operation)
        return result


def _register_change(name: str, by: str, label: str) -> None:
    sql = f"""
, sums AS (SELECT {label} AS "group", CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS value FROM sales GROUP BY 1)
SELECT "group", value, (value / nullif(lag(value) OVER (ORDER BY "group" NULLS LAST), 0) - 1) * 100 AS percentage_change FROM sums"""

    @register(name, with_sales(sql))
    def build(spark, sf_dir):
        columns = {"order_date"} if by in LABELS else {by}
        return doubles(period_change(sales(spark, sf_dir, *columns, "revenue"), "revenue", by), "value")


for _unit in LABELS:
    _register_by_time(_unit)
_register_change("mom_revenue", "month", LABELS["month"])
_register_change("qoq_revenue", "quarter", LABELS["quarter"])
_register_change("yoy_revenue", "year", LABELS["year"])
_register_change("pct_change_by_category", "category", "category")


def _register_group(name: str, aggregation: str, metric: str, by: str, exact: bool, descending: bool = True) -> None:
    sql = f'SELECT {by} AS "group", {_sql_statistic(aggregation, metric, exact)} AS value FROM sales GROUP BY 1'

    @register(name, with_sales(sql))
    def build(spark, sf_dir):
        result = group_aggregate(sales(spark, sf_dir, by, metric), by, metric, aggregation, descending=descending)
        return _rounded(result, aggregation, "value", exact)


_register_group("group_sum", "sum", "revenue", "category", True)
_register_group("group_sum_asc", "sum", "profit", "region", True, descending=False)
_register_group("group_mean", "mean", "profit", "product", True)
_register_group("group_median", "median", "quantity", "product", False)
_register_group("group_min", "min", "revenue", "salesperson", True)
_register_group("group_max", "max", "revenue", "salesperson", True)
_register_group("group_count", "count", "discount", "product", False)
_register_group("revenue_by_salesperson", "sum", "revenue", "salesperson", True)
_register_group("revenue_by_region", "sum", "revenue", "region", True)


@register("group_sum_in_period", with_sales("""
SELECT category AS "group", CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS value, CAST(sum(count(*)) OVER () AS BIGINT) AS rows_analyzed
FROM sales WHERE strftime(order_date, '%Y-%m') = '2000-09' GROUP BY 1"""))
def group_sum_in_period(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "category", "revenue")
    result = group_aggregate(df, "category", "revenue", "sum", period="September 2000")
    rows = rows_analyzed(sales(spark, sf_dir, "order_date"), "September 2000")
    return doubles(result.withColumn("rows_analyzed", rows), "value")


@register("monthly_trend", with_sales(
    f'SELECT {LABELS["month"]} AS "group", CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS value FROM sales GROUP BY 1'))
def monthly_trend(spark, sf_dir):
    return doubles(statistics(sales(spark, sf_dir, "order_date", "revenue"), "sum", "revenue", "month"), "value")


@register("products_high_quantity", with_sales("""
SELECT product AS "group", count(order_id) AS value FROM sales WHERE quantity > 49 GROUP BY 1"""))
def products_high_quantity(spark, sf_dir):
    large = filter_rows(sales(spark, sf_dir, "order_id", "product", "quantity"), "quantity", "greater_than", 49)
    return group_aggregate(large, "product", "order_id", "count")


def _comparison_sql(by: str) -> str:
    return f"""
, labeled AS (SELECT {by} AS "group", strftime(order_date, '%Y-%m') AS period, revenue FROM sales),
latest AS (SELECT max(period) AS period FROM labeled),
previous AS (SELECT max(period) AS period FROM labeled WHERE period < (SELECT period FROM latest)),
sums AS (SELECT "group",
                coalesce(sum(revenue) FILTER (WHERE period = (SELECT period FROM previous)), 0) AS previous_value,
                coalesce(sum(revenue) FILTER (WHERE period = (SELECT period FROM latest)), 0) AS latest_value
         FROM labeled WHERE period >= (SELECT period FROM previous) GROUP BY 1),
comparison AS (SELECT "group", CAST(previous_value AS DOUBLE) AS previous_value, CAST(latest_value AS DOUBLE) AS latest_value,
                      CAST(latest_value - previous_value AS DOUBLE) AS change,
                      CAST(latest_value - previous_value AS DOUBLE) / nullif(CAST(previous_value AS DOUBLE), 0) * 100 AS percentage_change
               FROM sums)
"""


def _register_comparison(by: str) -> None:
    @register(f"period_comparison_{by}", with_sales(_comparison_sql(by) + "SELECT * FROM comparison"))
    def build(spark, sf_dir):
        result = compare_periods(sales(spark, sf_dir, "order_date", by, "revenue"), "revenue", by)
        return doubles(result, "previous_value", "latest_value", "change")


for _dimension in ("category", "region", "product", "salesperson"):
    _register_comparison(_dimension)


@register("largest_decline", with_sales(
    _comparison_sql("category") + 'SELECT * FROM comparison ORDER BY change, "group" NULLS LAST LIMIT 1'))
def decline(spark, sf_dir):
    result = largest_decline(sales(spark, sf_dir, "order_date", "category", "revenue"), "revenue", "category")
    return doubles(result, "previous_value", "latest_value", "change")


@register("pivot_category_month", with_sales("""
SELECT category AS "group",
       CAST(coalesce(sum(revenue) FILTER (WHERE strftime(order_date, '%Y-%m') = '2001-06'), 0) AS DOUBLE) AS "2001-06",
       CAST(coalesce(sum(revenue) FILTER (WHERE strftime(order_date, '%Y-%m') = '2001-07'), 0) AS DOUBLE) AS "2001-07"
FROM sales WHERE strftime(order_date, '%Y-%m') IN ('2001-06', '2001-07') GROUP BY 1"""))
def pivot_category_month(spark, sf_dir):
    months = ["2001-06", "2001-07"]
    df = sales(spark, sf_dir, "order_date", "category", "revenue")
    return doubles(pivot_sum(df, "revenue", "category", "month", months), *months)


@register("revenue_share_category", with_sales("""
, sums AS (SELECT category AS "group", sum(revenue) AS value FROM sales GROUP BY 1)
SELECT "group", CAST(value AS DOUBLE) AS value,
       CAST(value AS DOUBLE) / nullif(CAST((SELECT sum(value) FROM sums) AS DOUBLE), 0) * 100 AS share FROM sums"""))
def revenue_share_category(spark, sf_dir):
    return doubles(share_of_total(sales(spark, sf_dir, "category", "revenue"), "revenue", "category"), "value")


@register("quantity_deviation", with_sales("""
, level AS (SELECT avg(quantity) AS mean, stddev_samp(quantity) AS std FROM sales),
far AS (SELECT order_id, quantity, (quantity - mean) / nullif(std, 0) AS deviation FROM sales, level)
SELECT order_id, quantity, round(deviation, 6) AS deviation FROM far WHERE abs(deviation) >= 1.65"""))
def quantity_deviation(spark, sf_dir):
    result = deviations(sales(spark, sf_dir, "order_id", "quantity"), "quantity", 1.65)
    return result.withColumn("deviation", F.round("deviation", 6))


@register("missing_by_month", with_sales("""
SELECT region, strftime(order_date, '%Y-%m') AS month, count(*) AS rows, count(*) FILTER (WHERE discount IS NULL) AS missing
FROM sales GROUP BY 1, 2"""))
def missing_by_month(spark, sf_dir):
    return missing_by(sales(spark, sf_dir, "region", "order_date", "discount"), "discount", ["region", "month"])


@register("chart_line", with_sales(
    f"SELECT {LABELS['month']} AS x, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS y FROM sales GROUP BY 1"))
def chart_line(spark, sf_dir):
    return doubles(chart_series(sales(spark, sf_dir, "order_date", "revenue"), "line", "month", "revenue"), "y")


@register("chart_bar", with_sales(
    "SELECT salesperson AS x, CAST(sum(profit) AS DOUBLE) / count(profit) AS y FROM sales GROUP BY 1"))
def chart_bar(spark, sf_dir):
    return chart_series(sales(spark, sf_dir, "salesperson", "profit"), "bar", "salesperson", "profit", "mean")


@register("chart_bar_in_period", with_sales("""
SELECT region AS x, round(median(quantity), 6) AS y FROM sales WHERE year(order_date) = 2000 GROUP BY 1"""))
def chart_bar_in_period(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "region", "quantity")
    return _rounded(chart_series(df, "bar", "region", "quantity", "median", period="2000"), "median", "y")


@register("chart_pie", with_sales("""
, slices AS (SELECT category AS x, sum(revenue) AS y FROM sales GROUP BY 1)
SELECT x, CAST(y AS DOUBLE) AS y, CAST(y AS DOUBLE) / nullif(CAST((SELECT sum(y) FROM slices) AS DOUBLE), 0) * 100 AS percent
FROM slices"""))
def chart_pie(spark, sf_dir):
    return doubles(chart_series(sales(spark, sf_dir, "category", "revenue"), "pie", "category", "revenue"), "y")


@register("chart_scatter", with_sales("""
SELECT CAST(quantity AS VARCHAR) AS x, discount AS y, (SELECT count(*) FROM sales WHERE discount IS NOT NULL) AS points
FROM sales WHERE quantity IS NOT NULL AND discount IS NOT NULL ORDER BY quantity, discount LIMIT 100"""))
def chart_scatter(spark, sf_dir):
    return chart_points(scatter_points(sales(spark, sf_dir, "quantity", "discount"), "quantity", "discount"))


@register("chart_scatter_all", with_sales("""
SELECT quantity AS x, CAST(revenue AS DOUBLE) AS y FROM sales WHERE quantity IS NOT NULL AND revenue IS NOT NULL"""))
def chart_scatter_all(spark, sf_dir):
    return doubles(scatter_points(sales(spark, sf_dir, "quantity", "revenue"), "quantity", "revenue"), "y")
