"""Subtotals of the sales, and the difference of two snapshots of the orders."""

from pyspark.sql import functions as F

from ledgerscope.operators.lattice import subtotals
from ledgerscope.operators.snapshots import snapshot_difference
from ledgerscope.sources.star import read_table, sales
from workload.registry import doubles, register, with_sales


def _monthly(spark, sf_dir):
    return sales(spark, sf_dir, "order_date", "category", "region", "customer_id", "revenue").withColumn("month", F.date_format("order_date", "yyyy-MM"))


CUBE_SQL = """SELECT category, region, month, GROUPING(category, region, month) AS level, count(*) AS "rows", CAST(sum(revenue) AS DOUBLE) AS revenue,
       count(DISTINCT customer_id) AS customers
FROM (SELECT *, strftime(order_date, '%Y-%m') AS month FROM sales) GROUP BY """


@register("subtotals_cube", with_sales(CUBE_SQL + "CUBE (category, region, month)"))
def subtotals_cube(spark, sf_dir):
    return doubles(subtotals(_monthly(spark, sf_dir), ["category", "region", "month"], {"revenue": "revenue"}, ("customer_id", "customers")), "revenue")


@register("subtotals_rollup", with_sales(CUBE_SQL + "ROLLUP (category, region, month)"))
def subtotals_rollup(spark, sf_dir):
    found = subtotals(_monthly(spark, sf_dir), ["category", "region", "month"], {"revenue": "revenue"}, ("customer_id", "customers"), "rollup")
    return doubles(found, "revenue")


@register("snapshot_orders", """
WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 89 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 101 = 0),
new AS (SELECT CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 97 <> 0),
gone AS (SELECT * FROM old EXCEPT ALL SELECT * FROM new), come AS (SELECT * FROM new EXCEPT ALL SELECT * FROM old),
a AS (SELECT o_orderkey, count(*) AS n, list_sort(list(coalesce(CAST(o_custkey AS VARCHAR), ''))) AS c, list_sort(list(coalesce(o_orderstatus, ''))) AS s, list_sort(list(coalesce(CAST(o_totalprice AS VARCHAR), ''))) AS p FROM old GROUP BY 1),
b AS (SELECT o_orderkey, count(*) AS n, list_sort(list(coalesce(CAST(o_custkey AS VARCHAR), ''))) AS c, list_sort(list(coalesce(o_orderstatus, ''))) AS s, list_sort(list(coalesce(CAST(o_totalprice AS VARCHAR), ''))) AS p FROM new GROUP BY 1),
g AS (SELECT o_orderkey, count(*) AS n FROM gone GROUP BY 1), k AS (SELECT o_orderkey, count(*) AS n FROM come GROUP BY 1),
d AS (SELECT o_orderkey FROM g UNION SELECT o_orderkey FROM k)
SELECT d.o_orderkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change,
       coalesce(k.n, 0) AS rows_added, coalesce(g.n, 0) AS rows_removed,
       CASE WHEN a.n = b.n THEN concat_ws(',', CASE WHEN a.c <> b.c THEN 'o_custkey' END, CASE WHEN a.s <> b.s THEN 'o_orderstatus' END, CASE WHEN a.p <> b.p THEN 'o_totalprice' END) ELSE '' END AS changed_columns
FROM d LEFT JOIN a ON d.o_orderkey IS NOT DISTINCT FROM a.o_orderkey LEFT JOIN b ON d.o_orderkey IS NOT DISTINCT FROM b.o_orderkey
LEFT JOIN g ON d.o_orderkey IS NOT DISTINCT FROM g.o_orderkey LEFT JOIN k ON d.o_orderkey IS NOT DISTINCT FROM k.o_orderkey""")
def snapshot_orders(spark, sf_dir):
    """The old snapshot lacks some orders and has some twice; the new one lacks others and has some without key, with another status or without price."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    old = orders.where(key % 89 != 0).union(orders.where(key % 101 == 0))
    new = orders.where(key % 97 != 0).select(
        F.when(key % 71 != 0, key).alias("o_orderkey"), "o_custkey",
        F.when(key % 53 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 59 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return snapshot_difference(old, new, ["o_orderkey"])
