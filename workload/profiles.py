"""Profile, derivations, constraints and the business questions."""

from pyspark.sql import functions as F

from ledgerscope.functions.money import derive_financials
from ledgerscope.operators.constraints import check_constraints
from ledgerscope.operators.profile import (
    profile_dates, profile_duplicates, profile_header, profile_missing, profile_numeric, profile_sample, profile_types,
)
from ledgerscope.operators.updates import apply_overrides
from ledgerscope.plans import questions
from ledgerscope.plans.checks import check_sections, checks_summary, judge, run_checks
from ledgerscope.sources.star import SALES_COLUMNS, cost_percent, read_table, sales
from workload.registry import doubles, register, sales_table, with_sales

NUMERIC_COLUMNS = ("order_id", "customer_id", "quantity", "unit_price", "discount", "revenue", "cost", "profit")

# Spark's names of the column types.
TYPE_NAMES = {
    "order_id": "bigint", "order_date": "timestamp_ntz", "customer_id": "bigint", "product": "string",
    "category": "string", "region": "string", "quantity": "double", "unit_price": "double", "discount": "double",
    "revenue": "decimal(18,4)", "cost": "decimal(17,4)", "profit": "decimal(19,4)", "salesperson": "string",
}


def _per_column(template: str, names) -> str:
    return "\nUNION ALL\n".join(template.format(name=name, kind=TYPE_NAMES[name]) for name in names)


@register("profile_header", with_sales("SELECT count(*) AS rows, CAST(13 AS BIGINT) AS columns FROM sales"))
def header(spark, sf_dir):
    return profile_header(sales(spark, sf_dir, "order_id"), len(SALES_COLUMNS))


@register("profile_types", with_sales(
    _per_column("SELECT '{name}' AS column, '{kind}' AS data_type, count({name}) AS filled FROM sales", SALES_COLUMNS)))
def types(spark, sf_dir):
    return profile_types(sales(spark, sf_dir))


@register("profile_missing", with_sales(
    _per_column("SELECT '{name}' AS column, count(*) - count({name}) AS missing FROM sales", SALES_COLUMNS)))
def missing(spark, sf_dir):
    return profile_missing(sales(spark, sf_dir))


@register("profile_duplicates", with_sales("""
SELECT (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS duplicate_rows,
       (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT order_id FROM sales)) AS duplicate_keys"""))
def duplicates(spark, sf_dir):
    return profile_duplicates(sales(spark, sf_dir), "order_id")


@register("profile_date_ranges", with_sales("""
SELECT 'order_date' AS column, strftime(min(order_date), '%Y-%m-%dT%H:%M:%S') AS min,
       strftime(max(order_date), '%Y-%m-%dT%H:%M:%S') AS max FROM sales"""))
def date_ranges(spark, sf_dir):
    return profile_dates(sales(spark, sf_dir, "order_date"))


@register("profile_numeric", with_sales(_per_column("""
SELECT '{name}' AS column, count({name}) AS count, CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max,
       round(CAST(sum({name}) AS DOUBLE) / count({name}), 6) AS mean, round(median(CAST({name} AS DOUBLE)), 6) AS median
FROM sales""", NUMERIC_COLUMNS)))
def numbers(spark, sf_dir):
    profile = profile_numeric(sales(spark, sf_dir))
    return profile.withColumns({name: F.round(name, 6) for name in ("mean", "median")})


@register("profile_sample", with_sales("""
SELECT order_id, order_date, customer_id, product, category, region, quantity, unit_price, discount,
       CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, CAST(profit AS DOUBLE) AS profit, salesperson
FROM sales ORDER BY """ + ", ".join(f"{name} NULLS LAST" for name in SALES_COLUMNS) + " LIMIT 5"))
def sample(spark, sf_dir):
    return doubles(profile_sample(sales(spark, sf_dir), list(SALES_COLUMNS), 5), "revenue", "cost", "profit")


LINES = """lines AS (
SELECT l_orderkey AS order_id, l_linenumber AS line, p_type AS category, CAST(l_quantity AS INT) AS quantity,
       CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price, CAST(l_discount AS DECIMAL(5,4)) AS discount,
       CAST(CASE p_type WHEN 'ECONOMY' THEN 0.41 WHEN 'SMALL' THEN 0.53 WHEN 'STANDARD' THEN 0.59
            WHEN 'MEDIUM' THEN 0.67 WHEN 'LARGE' THEN 0.74 ELSE 0.79 END AS DECIMAL(5,4)) AS cost_ratio
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""
GROSS = "CAST({quantity} AS DECIMAL(10,0)) * unit_price"
MEASURES = (
    f"CAST(round({GROSS} * (1 - discount), 2) AS DOUBLE) AS revenue, "
    f"CAST(round({GROSS} * cost_ratio, 2) AS DOUBLE) AS cost, "
    f"CAST(round({GROSS} * (1 - discount), 2) - round({GROSS} * cost_ratio, 2) AS DOUBLE) AS profit"
)


def _lines(spark, sf_dir):
    """Order lines at list price, with the lookup of cost ratios by category."""
    part = read_table(spark, sf_dir, "part")
    priced = read_table(spark, sf_dir, "lineitem").join(
        part.select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    lines = priced.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
        F.col("l_discount").cast("decimal(5,4)").alias("discount"),
    )
    ratios = part.select(F.col("p_type").alias("category")).distinct()
    ratio = (cost_percent(F.col("category")) / 100).cast("decimal(5,4)")
    return derive_financials(lines, ratios.withColumn("cost_ratio", ratio), "category")


@register("derive_financials", f"""
WITH {LINES}
SELECT order_id, line, quantity, {MEASURES.format(quantity='quantity')} FROM lines""")
def financials(spark, sf_dir):
    derived = _lines(spark, sf_dir).select("order_id", "line", "quantity", "revenue", "cost", "profit")
    return doubles(derived, "revenue", "cost", "profit")


@register("apply_overrides", f"""
WITH {LINES},
changes AS (SELECT o_orderkey, CAST(10 + o_orderkey % 5 AS INT) AS new_quantity FROM orders WHERE o_orderpriority = '1-URGENT'),
changed AS (SELECT * REPLACE (coalesce(new_quantity, quantity) AS quantity) FROM lines LEFT JOIN changes ON order_id = o_orderkey)
SELECT order_id, line, quantity, {MEASURES.format(quantity='quantity')} FROM changed""")
def overrides(spark, sf_dir):
    urgent = read_table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    changes = urgent.select(
        F.col("o_orderkey").alias("order_id"), (F.lit(10) + F.col("o_orderkey") % 5).cast("int").alias("quantity")
    )
    updated = apply_overrides(_lines(spark, sf_dir), changes, "order_id")
    return doubles(updated.select("order_id", "line", "quantity", "revenue", "cost", "profit"), "revenue", "cost", "profit")


MEASURE_COLUMNS = ("quantity", "unit_price", "revenue", "cost", "profit")


@register("constraint_checks", with_sales("""
, found AS (
SELECT 'required columns' AS "constraint", CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'rows between 500 and 2000', greatest(500 - count(*), 0) + greatest(count(*) - 2000, 0) FROM sales
UNION ALL SELECT 'unique order_id', (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT order_id FROM sales))
UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'no missing {name}', count(*) - count({name}) FROM sales" for name in MEASURE_COLUMNS) + """)
SELECT "constraint", violations, violations = 0 AS passed FROM found"""))
def constraints(spark, sf_dir):
    checked = sales(spark, sf_dir, "order_id", *MEASURE_COLUMNS)
    return check_constraints(checked, SALES_COLUMNS, "order_id", MEASURE_COLUMNS, 500, 2000, SALES_COLUMNS)


@register("kpi_totals", with_sales("""
SELECT count(*) AS rows, sum(quantity) AS total_quantity, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(cost) AS DOUBLE) AS total_cost, CAST(sum(profit) AS DOUBLE) AS total_profit FROM sales"""))
def kpi(spark, sf_dir):
    return doubles(questions.kpi_totals(sales_table(spark, sf_dir)), "total_revenue", "total_cost", "total_profit")


LARGE = 49


@register("large_orders", with_sales(f"""
SELECT order_id, order_date, product, category, region, quantity, CAST(revenue AS DOUBLE) AS revenue
FROM sales WHERE quantity > {LARGE}"""))
def large_orders(spark, sf_dir):
    return doubles(questions.large_orders(sales_table(spark, sf_dir), LARGE), "revenue")


LATEST_SQL = """
, monthly AS (SELECT strftime(order_date, '%Y-%m') AS month, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS value
              FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
changes AS (SELECT lag(month) OVER (ORDER BY month) AS previous_month, lag(value) OVER (ORDER BY month) AS previous_value,
                   month AS latest_month, value AS latest_value,
                   (value / nullif(lag(value) OVER (ORDER BY month), 0) - 1) * 100 AS percentage_change FROM monthly),
latest AS (SELECT * FROM changes ORDER BY latest_month DESC LIMIT 1),
by_category AS (SELECT category, sum(revenue) AS revenue,
                       coalesce(sum(revenue) FILTER (WHERE strftime(order_date, '%Y-%m') = (SELECT previous_month FROM latest)), 0) AS before,
                       coalesce(sum(revenue) FILTER (WHERE strftime(order_date, '%Y-%m') = (SELECT latest_month FROM latest)), 0) AS after
                FROM sales GROUP BY 1),
decline AS (SELECT category, CAST(after - before AS DOUBLE) AS change,
                   CAST(after - before AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) * 100 AS pct
            FROM by_category ORDER BY after - before, category NULLS LAST LIMIT 1),
top AS (SELECT category, revenue FROM by_category ORDER BY revenue DESC NULLS LAST, category NULLS LAST LIMIT 1)
"""


@register("q1_sales_decrease", with_sales(LATEST_SQL + """
SELECT latest.*, category AS largest_decline, change AS largest_decline_change, pct AS largest_decline_percentage_change
FROM latest, decline"""))
def q1(spark, sf_dir):
    result = questions.sales_decrease(sales_table(spark, sf_dir))
    return doubles(result, "previous_value", "latest_value", "largest_decline_change")


@register("q2_top_category", with_sales(LATEST_SQL + "SELECT category, CAST(revenue AS DOUBLE) AS revenue FROM top"))
def q2(spark, sf_dir):
    return doubles(questions.top_category(sales_table(spark, sf_dir)), "revenue")


@register("q3_region_margin", with_sales("""
SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
       CAST(sum(profit) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) * 100 AS profit_margin FROM sales GROUP BY 1"""))
def q3(spark, sf_dir):
    return doubles(questions.region_margins(sales_table(spark, sf_dir)), "revenue", "profit")


@register("q4_unusual_patterns", with_sales(f"""
SELECT count(*) FILTER (WHERE quantity > {LARGE}) AS large_orders, max(quantity) FILTER (WHERE quantity > {LARGE}) AS largest_quantity,
       count(*) - count(discount) AS missing_discounts FROM sales"""))
def q4(spark, sf_dir):
    return questions.unusual_patterns(sales_table(spark, sf_dir), LARGE)


@register("q5_management_summary", with_sales(LATEST_SQL + """
SELECT count(*) AS rows, CAST(13 AS BIGINT) AS columns, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(profit) AS DOUBLE) AS total_profit, count(*) - count(discount) AS missing_discounts,
       (SELECT category FROM top) AS top_category, (SELECT latest_month FROM latest) AS latest_month,
       (SELECT percentage_change FROM latest) AS latest_change FROM sales"""))
def q5(spark, sf_dir):
    result = questions.management_summary(sales_table(spark, sf_dir), len(SALES_COLUMNS))
    return doubles(result, "total_revenue", "total_profit")


RULES = [
    ("q1", "percentage_change", "<", "0"),
    ("q1", "largest_decline", "filled", None),
    ("q1", "largest_decline_change", "<", "0"),
    ("q2", "category", "=", "PROMO"),
    ("q3", "profit_margin", ">", "20"),
    ("q3", "region", "filled", None),
    ("q4", "large_orders", ">", "0"),
    ("q4", "largest_quantity", "=", "50"),
    ("q4", "missing_discounts", ">", "0"),
    ("q5", "rows", ">=", "500"),
    ("q5", "rows", "<=", "2000"),
    ("q5", "columns", "=", "13"),
    ("q5", "total_revenue", ">", "0"),
    ("q5", "latest_change", "<", "0"),
]

EVIDENCE_SQL = LATEST_SQL + f""", margins AS (SELECT region, sum(revenue) AS revenue, sum(profit) AS profit FROM sales GROUP BY 1),
margin AS (SELECT region, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit,
                  CAST(profit AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0) * 100 AS profit_margin FROM margins
           ORDER BY profit_margin DESC NULLS LAST, region NULLS LAST LIMIT 1),
patterns AS (SELECT count(*) FILTER (WHERE quantity > {LARGE}) AS large_orders,
                    max(quantity) FILTER (WHERE quantity > {LARGE}) AS largest_quantity,
                    count(*) - count(discount) AS missing_discounts, count(*) AS rows,
                    sum(revenue) AS total_revenue, sum(profit) AS total_profit FROM sales),
evidence(question, name, text, number) AS (
SELECT 'q1', 'previous_month', previous_month, CAST(NULL AS DOUBLE) FROM latest
UNION ALL SELECT 'q1', 'previous_value', NULL, previous_value FROM latest
UNION ALL SELECT 'q1', 'latest_month', latest_month, NULL FROM latest
UNION ALL SELECT 'q1', 'latest_value', NULL, latest_value FROM latest
UNION ALL SELECT 'q1', 'percentage_change', NULL, percentage_change FROM latest
UNION ALL SELECT 'q1', 'largest_decline', category, NULL FROM decline
UNION ALL SELECT 'q1', 'largest_decline_change', NULL, change FROM decline
UNION ALL SELECT 'q1', 'largest_decline_percentage_change', NULL, pct FROM decline
UNION ALL SELECT 'q2', 'category', category, NULL FROM top
UNION ALL SELECT 'q2', 'revenue', NULL, CAST(revenue AS DOUBLE) FROM top
UNION ALL SELECT 'q3', 'region', region, NULL FROM margin
UNION ALL SELECT 'q3', 'revenue', NULL, revenue FROM margin
UNION ALL SELECT 'q3', 'profit', NULL, profit FROM margin
UNION ALL SELECT 'q3', 'profit_margin', NULL, profit_margin FROM margin
UNION ALL SELECT 'q4', 'large_orders', NULL, large_orders FROM patterns
UNION ALL SELECT 'q4', 'largest_quantity', NULL, largest_quantity FROM patterns
UNION ALL SELECT 'q4', 'missing_discounts', NULL, missing_discounts FROM patterns
UNION ALL SELECT 'q5', 'rows', NULL, rows FROM patterns
UNION ALL SELECT 'q5', 'columns', NULL, 13 FROM patterns
UNION ALL SELECT 'q5', 'total_revenue', NULL, CAST(total_revenue AS DOUBLE) FROM patterns
UNION ALL SELECT 'q5', 'total_profit', NULL, CAST(total_profit AS DOUBLE) FROM patterns
UNION ALL SELECT 'q5', 'missing_discounts', NULL, missing_discounts FROM patterns
UNION ALL SELECT 'q5', 'top_category', category, NULL FROM top
UNION ALL SELECT 'q5', 'latest_month', latest_month, NULL FROM latest
UNION ALL SELECT 'q5', 'latest_change', NULL, percentage_change FROM latest)
"""


def _evidence(spark, sf_dir):
    table = sales_table(spark, sf_dir)
    return run_checks(spark, {
        "q1": lambda: questions.sales_decrease(table),
        "q2": lambda: questions.top_category(table),
        "q3": lambda: questions.region_margins(table).limit(1),
        "q4": lambda: questions.unusual_patterns(table, LARGE),
        "q5": lambda: questions.management_summary(table, len(SALES_COLUMNS)),
    })


@register("check_evidence", with_sales(EVIDENCE_SQL + "SELECT question, name, text, number FROM evidence"))
def check_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


def _rule_sql() -> str:
    def quote(value):
        return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"

    return ", ".join("(" + ", ".join(quote(value) for value in rule) + ")" for rule in RULES)


JUDGED_SQL = f""",
rules(question, name, comparison, expected) AS (VALUES {_rule_sql()}),
judged AS (SELECT rules.question, coalesce(CASE comparison
    WHEN '=' THEN coalesce(text = expected, number = TRY_CAST(expected AS DOUBLE))
    WHEN '<' THEN number < TRY_CAST(expected AS DOUBLE) WHEN '<=' THEN number <= TRY_CAST(expected AS DOUBLE)
    WHEN '>' THEN number > TRY_CAST(expected AS DOUBLE) WHEN '>=' THEN number >= TRY_CAST(expected AS DOUBLE)
    WHEN 'filled' THEN text IS NOT NULL OR number IS NOT NULL END, FALSE) AS holds
  FROM rules LEFT JOIN evidence ON rules.question = evidence.question AND rules.name = evidence.name),
results AS (SELECT question, count(*) AS rules, count(*) FILTER (WHERE NOT holds) AS failed, bool_and(holds) AS passed
            FROM judged GROUP BY 1)
"""


def _rules(spark):
    return spark.createDataFrame(RULES, "question string, name string, comparison string, expected string")


@register("checks_summary", with_sales(EVIDENCE_SQL + JUDGED_SQL + """
SELECT *, (SELECT count(*) FROM results WHERE passed) AS passed_count, (SELECT count(*) FROM results) AS total_count FROM results"""))
def checks(spark, sf_dir):
    return checks_summary(judge(_evidence(spark, sf_dir), _rules(spark)))


TITLES_SQL = ", ".join(f"({number}, '{key}', '{title}')" for number, (key, title) in enumerate(questions.QUESTIONS.items(), 1))


@register("check_report", with_sales(EVIDENCE_SQL + JUDGED_SQL + f""",
titles(number, question, title) AS (VALUES {TITLES_SQL}),
shown AS (SELECT question, concat('- **', array_to_string(list_transform(string_split(name, '_'), lambda w: concat(upper(w[1]), w[2:])), ' '), ':** ',
                 coalesce(text, regexp_replace(CAST(CAST(number AS DECIMAL(30,4)) AS VARCHAR), '[.]?0+$', ''), 'None')) AS line FROM evidence),
bodies AS (SELECT question, string_agg(line, chr(10) ORDER BY line) AS lines FROM shown GROUP BY 1)
SELECT number, titles.question, concat('## ', number, '. ', title, chr(10), chr(10), '**Status:** ', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END,
       chr(10), chr(10), '**Evidence**', chr(10), chr(10), lines, chr(10), chr(10), '---', chr(10)) AS section
FROM titles JOIN results ON titles.question = results.question JOIN bodies ON titles.question = bodies.question"""))
def check_report(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    return check_sections(evidence, judge(evidence, _rules(spark)), questions.QUESTIONS)
