"""As-of and interval joins of events, running totals, moving averages and ranks of order lines.

Every third event is given to user 1, so that one key holds over a third of all rows. Orders are replayed in January
2024, a day of them in 18 minutes, so that they fall among the events.
"""

from pyspark.sql import functions as F

from ledgerscope.operators.asof import asof_join
from ledgerscope.operators.intervals import interval_join
from ledgerscope.operators.ordered import moving_average, ranks, running_totals, top_rows
from ledgerscope.sources.star import read_table
from workload.registry import doubles, register

EVENTS_SQL = "e AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, event_type FROM events)"
REPLAYED_SQL = "o AS (SELECT o_orderkey, o_custkey, to_timestamp(1704067200 + 1080 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))::TIMESTAMP AS placed, o_totalprice FROM orders)"


def _events(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events")
    return rows.select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"), "event_type")


def _orders(spark, sf_dir):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    placed = F.timestamp_seconds(F.lit(1704067200) + 1080 * days).cast("timestamp_ntz")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", placed.alias("placed"), "o_totalprice")


@register("asof_latest_order", f"""
WITH {EVENTS_SQL}, {REPLAYED_SQL}, latest AS (SELECT o_custkey, placed, max(o_orderkey) AS o_orderkey FROM o GROUP BY 1, 2)
SELECT event_id, user_id, e.ts, latest.placed, latest.o_orderkey FROM e ASOF LEFT JOIN latest ON e.user_id = latest.o_custkey AND e.ts >= latest.placed""")
def asof_latest_order(spark, sf_dir):
    found = asof_join(_events(spark, sf_dir), _orders(spark, sf_dir), {"user_id": "o_custkey"}, ("ts", "placed"), {"o_orderkey": "o_orderkey", "placed": "placed"}, rows=20_000)
    return found.select("event_id", "user_id", "ts", "placed", "o_orderkey")


@register("asof_last_view", f"""
WITH {EVENTS_SQL}, views AS (SELECT user_id, ts, max(event_id) AS view_id FROM e WHERE event_type = 'view' GROUP BY 1, 2),
bought AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT bought.event_id, bought.user_id, views.view_id, views.ts AS viewed FROM bought ASOF LEFT JOIN views ON bought.user_id = views.user_id AND bought.ts > views.ts""")
def asof_last_view(spark, sf_dir):
    events = _events(spark, sf_dir)
    bought, views = events.where("event_type = 'purchase'"), events.where("event_type = 'view'")
    found = asof_join(bought, views, {"user_id": "user_id"}, ("ts", "ts"), {"event_id": "view_id", "ts": "viewed"}, strict=True)
    return found.select("event_id", "user_id", "view_id", "viewed")


@register("interval_event_pairs", f"""
WITH {EVENTS_SQL}
SELECT a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 15 MINUTE""")
def interval_event_pairs(spark, sf_dir):
    events = _events(spark, sf_dir)
    after = events.select(F.col("event_id").alias("first_id"), F.col("user_id").alias("of_user"), F.col("ts").alias("starts"), (F.col("ts") + F.expr("interval 15 minutes")).alias("stops"))
    pairs = interval_join(events, after, {"user_id": "of_user"}, "ts", ("starts", "stops"), 9e8, open_start=True)
    return pairs.select("first_id", F.col("event_id").alias("second_id"))


@register("interval_order_events", f"""
WITH {EVENTS_SQL}, {REPLAYED_SQL}
SELECT o_orderkey, event_id, event_type FROM o JOIN e ON o_custkey = user_id AND ts >= placed AND ts <= placed + to_seconds(CAST(floor(o_totalprice) AS BIGINT))""")
def interval_order_events(spark, sf_dir):
    """Each order is open for as many seconds as its price, from minutes to days."""
    orders = _orders(spark, sf_dir)
    closes = F.timestamp_seconds(F.unix_seconds(F.col("placed").cast("timestamp")) + F.floor("o_totalprice")).cast("timestamp_ntz")
    spans = orders.withColumn("closes", closes)
    return interval_join(_events(spark, sf_dir), spans, {"user_id": "o_custkey"}, "ts", ("placed", "closes"), 3.6e9).select("o_orderkey", "event_id", "event_type")


LINES_SQL = "lines AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue, CAST(l_quantity AS DECIMAL(12,2)) AS quantity FROM lineitem)"


def _lines(spark, sf_dir):
    money = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", money.alias("revenue"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"))


@register("running_revenue", f"""
WITH {LINES_SQL}
SELECT l_shipdate, l_orderkey, l_linenumber, CAST(sum(revenue) OVER w AS DOUBLE) AS revenue_so_far, row_number() OVER w AS line_number
FROM lines WINDOW w AS (ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, revenue NULLS FIRST ROWS UNBOUNDED PRECEDING)""")
def running_revenue(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_shipdate", "l_orderkey", "l_linenumber", "revenue")
    found = running_totals(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], {"revenue": "revenue_so_far"}, number="line_number")
    return doubles(found.drop("revenue"), "revenue_so_far")


@register("moving_quantity", f"""
WITH {LINES_SQL}
SELECT l_shipdate, l_orderkey, l_linenumber, l_returnflag, CAST(sum(quantity) OVER w AS DOUBLE) / count(quantity) OVER w AS quantity_of_100
FROM lines WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, quantity NULLS FIRST ROWS 99 PRECEDING)""")
def moving_quantity(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "quantity")
    return moving_average(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "quantity", 100, "quantity_of_100", ["l_returnflag"]).drop("quantity")


RANKS_SQL = "SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank FROM lineitem WINDOW w AS (ORDER BY {order})"


@register("rank_prices", RANKS_SQL.format(order="l_extendedprice DESC NULLS LAST"))
def rank_prices(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks(lines, "l_extendedprice", descending=True).drop("l_extendedprice")


@register("rank_quantities", RANKS_SQL.format(order="l_quantity NULLS LAST"))
def rank_quantities(spark, sf_dir):
    """Fifty values share all lines, so every rank has many ties."""
    return ranks(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@register("top_lines_by_flag", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, l_returnflag, l_orderkey, l_linenumber) AS place FROM lineitem)
WHERE place <= 25""")
def top_lines_by_flag(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_rows(lines, "l_returnflag", [F.col("l_extendedprice").desc_nulls_last()], 25)
