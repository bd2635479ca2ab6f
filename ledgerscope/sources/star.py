"""The 13-column sales table as a view over order, part and party tables.

A query names the columns it needs and only the tables behind them are joined.
All joins are left joins to unique keys, so leaving one out changes no row. The
joins carry no broadcast hints: Spark broadcasts a side whose file size is
below its threshold, and otherwise shuffles and lets adaptive execution split
keys that hold much of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError

# The columns of a sales table.
SALES_COLUMNS = (
    "order_id", "order_date", "customer_id", "product", "category", "region", "quantity",
    "unit_price", "discount", "revenue", "cost", "profit", "salesperson",
)

# Chosen for these tables: cost in percent of the list price, by category.
COST_PERCENT = {"ECONOMY": 41, "SMALL": 53, "STANDARD": 59, "MEDIUM": 67, "LARGE": 74}
OTHER_COST_PERCENT = 79


# The schemas of the source tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One source table; the stated schema saves a job that reads file footers."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cost_percent(category: Column) -> Column:
    percent = F.lit(OTHER_COST_PERCENT)
    for name, value in COST_PERCENT.items():
        percent = F.when(category == name, F.lit(value)).otherwise(percent)
    return percent


def _hundredths(number: Column) -> Column:
    """A double of two decimals as a whole number of hundredths."""
    return F.floor(number * 100 + 0.5)


def _money(ten_thousandths: Column, precision: int) -> Column:
    """Whole ten-thousandths as DECIMAL with four places."""
    amount = ten_thousandths.cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")
    return amount.cast(f"decimal({precision},4)")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The sales table with the given columns, or all 13."""
    wanted = columns or SALES_COLUMNS
    unknown = [name for name in wanted if name not in SALES_COLUMNS]
    if unknown:
        raise ColumnError(f"no such column: {', '.join(unknown)}")
    needed = set(wanted)

    rows = read_table(spark, sf_dir, "lineitem")
    if needed & {"order_date", "customer_id", "region"}:
        orders = _orders(spark, sf_dir, with_region="region" in needed)
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if needed & {"product", "category", "cost", "profit"}:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if "salesperson" in needed:
        supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select(*(_expression(name).alias(name) for name in wanted))


def _orders(spark: SparkSession, sf_dir: str, with_region: bool) -> DataFrame:
    """Orders with the region of their customer, joined before the larger line table."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    if not with_region:
        return orders
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    customer = customer.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return orders.join(customer.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey"), "left")


def _expression(name: str) -> Column:
    """One sales column. Money is computed in whole numbers, which is exact and
    several times cheaper than casting each double to DECIMAL first."""
    price = _hundredths(F.col("l_extendedprice"))
    revenue = price * (100 - _hundredths(F.col("l_discount")))
    if name == "unit_price":
        return F.col("l_extendedprice") / F.col("l_quantity")
    if name == "discount":
        return F.nullif(F.col("l_discount"), F.lit(0.0))
    if name == "revenue":
        return _money(revenue, 18)
    if name == "cost":
        return _money(price * cost_percent(F.col("p_type")), 17)
    if name == "profit":
        return _money(revenue - price * cost_percent(F.col("p_type")), 19)
    return F.col({
        "order_id": "l_orderkey", "order_date": "o_orderdate", "customer_id": "o_custkey", "product": "p_name",
        "category": "p_type", "region": "r_name", "quantity": "l_quantity", "salesperson": "s_name",
    }[name])
