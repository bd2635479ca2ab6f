"""Registered queries, each beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.star import sales

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}

# The sales view of ledgerscope.sources.star, stated independently in SQL.
SALES = """sales AS (
SELECT l_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer_id, product, category, region,
       quantity, unit_price, discount, revenue, cost, revenue - cost AS profit, salesperson
FROM (SELECT l_orderkey, o_orderdate, o_custkey, p_name AS product, p_type AS category, r_name AS region,
             l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, nullif(l_discount, 0.0) AS discount,
             CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
             CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(CASE p_type WHEN 'ECONOMY' THEN 0.41 WHEN 'SMALL' THEN 0.53
               WHEN 'STANDARD' THEN 0.59 WHEN 'MEDIUM' THEN 0.67 WHEN 'LARGE' THEN 0.74 ELSE 0.79 END AS DECIMAL(4,2)) AS cost,
             s_name AS salesperson
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
      LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) t)"""


def with_sales(body: str) -> str:
    """A statement over ``sales``; ``body`` starts with SELECT, or with a comma and further CTEs."""
    return f"WITH {SALES}{body}" if body.lstrip().startswith(",") else f"WITH {SALES}\n{body}"


def register(name: str, sql: str | None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, sql)
        return build

    return add


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Decimal columns as doubles, for comparison across engines."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def sales_table(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
    return lambda *names: sales(spark, sf_dir, *names)
