from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.money import derive_financials
from ledgerscope.functions.text import slug
from ledgerscope.operators.updates import apply_overrides
from ledgerscope.plans import questions
from ledgerscope.plans.checks import check_sections, checks_summary, judge, run_checks
from ledgerscope.plans.reports import rejected_questions, report_documents, write_reports

STEPS = "question_id bigint, seq int, tool string, arguments string, status string, message string"
QUESTIONS = "question_id bigint, question string, answer string, dataset string"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.sql("""
        SELECT order_id, CAST(d AS TIMESTAMP_NTZ) AS order_date, product, category, region, quantity, discount,
               CAST(r AS DECIMAL(18,2)) AS revenue, CAST(c AS DECIMAL(18,2)) AS cost, CAST(r - c AS DECIMAL(18,2)) AS profit
        FROM VALUES
        (1, '2026-08-03', 'Laptop', 'Electronics', 'North', 2L, 0.05D, 1000.00, 760.00),
        (2, '2026-08-09', 'Chair', 'Furniture', 'South', 3L, NULL, 500.00, 300.00),
        (3, '2026-09-01', 'Laptop', 'Electronics', 'North', 2L, 0.0D, 700.00, 532.00),
        (4, '2026-09-02', 'Desk', 'Furniture', 'East', 12L, 0.0D, 600.00, 408.00)
        AS t(order_id, d, product, category, region, quantity, discount, r, c)""")
    return lambda *names: df.select(*names)


def test_questions(table):
    q1 = questions.sales_decrease(table).first()
    assert (q1.previous_month, q1.latest_month, q1.largest_decline) == ("2026-08", "2026-09", "Electronics")
    assert q1.percentage_change == (1300 / 1500 - 1) * 100 and q1.largest_decline_change == -300
    assert q1.largest_decline_percentage_change == -30.0
    assert tuple(questions.top_category(table).first()) == ("Electronics", Decimal("1700.00"))
    assert [(r.region, r.profit_margin) for r in questions.region_margins(table).collect()] == [("South", 40.0), ("East", 32.0), ("North", 24.0)]
    assert tuple(questions.unusual_patterns(table, 5).first()) == (1, 12, 1)
    assert [r.order_id for r in questions.large_orders(table, 2).collect()] == [4, 2]
    q5 = questions.management_summary(table, 13).first()
    assert (q5.rows, q5.columns, q5.total_revenue, q5.total_profit) == (4, 13, Decimal("2800.00"), Decimal("800.00"))
    assert (q5.top_category, q5.latest_month, q5.missing_discounts) == ("Electronics", "2026-09", 1)


def test_checks(spark, table):
    def broken():
        raise ColumnError("no such column: region")

    evidence = run_checks(spark, {
        "q2": lambda: questions.top_category(table), "q3": broken,
        "q4": lambda: table("revenue").select("no_such_column"),
        "q5": lambda: questions.management_summary(table, 13),
    })
    errors = {r.question: r.text for r in evidence.where("name = 'error'").collect()}
    assert errors["q3"] == "ColumnError: no such column: region" and "no_such_column" in errors["q4"]
    rules = spark.createDataFrame(
        [("q2", "category", "=", "Electronics"), ("q2", "revenue", ">", "1000"), ("q3", "region", "filled", None),
         ("q5", "rows", "=", "4"), ("q5", "rows", ">=", "5"), ("q5", "absent", "<", "1")],
        "question string, name string, comparison string, expected string",
    )
    judged = judge(evidence, rules)
    rows = {r.question: (r.rules, r.failed, r.passed) for r in judged.collect()}
    assert rows == {"q2": (2, 0, True), "q3": (2, 2, False), "q4": (1, 1, False), "q5": (3, 2, False)}
    assert {(r.passed_count, r.total_count) for r in checks_summary(judged).collect()} == {(1, 4)}
    sections = {r.question: r.section for r in check_sections(evidence, judged, questions.QUESTIONS).collect()}
    assert sections["q2"].startswith("## 2. Which category generated the most revenue?\n\n**Status:** PASS")
    assert "- **Category:** Electronics" in sections["q2"] and "**Status:** FAIL" in sections["q3"]
    assert list(sections) == ["q1", "q2", "q3", "q4", "q5"]


def test_reports(spark):
    asked = spark.createDataFrame(
        [(1, "\n  Why did sales fall? \u2003\n", "They fell.", "sales.csv"), (2, "???", "None", "sales.csv"), (3, " \n\t\u00a0", "x", "d"), (4, "q", None, "d"), (5, "q", "a", "")],
        QUESTIONS,
    )
    steps = spark.createDataFrame(
        [(1, 2, "create_chart", "{'x': 1}", "error", "no such column"), (1, 1, "filter", "{}", "success", None),
         (1, 3, "stat", "{}", "error", None), (9, 1, "orphan", "{}", None, None)], STEPS)
    documents = {(r.question_id, r.seq): r for r in report_documents(asked, steps, "2026-09-15 10:30:00").collect()}
    assert set(documents) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)}
    assert {r.filename for r in documents.values()} == {"20260915_103000_why_did_sales_fall.md", "20260915_103000_analysis_report.md"}
    assert "**Dataset:** `sales.csv`" in documents[1, 0].block and "## Question\n\nWhy did sales fall?\n" in documents[1, 0].block
    assert documents[1, 1].block.startswith("### 1. `filter`") and "**Status:** Completed" in documents[1, 1].block
    assert "**Status:** Error — no such column" in documents[1, 2].block
    assert documents[1, 3].block == "### 3. `stat`\n\n**Arguments**\n\n```text\n{}\n```\n\n**Status:** Error — Unknown error\n"
    assert documents[2, 1].block == "No analytical tools were used.\n"
    reasons = {r.question_id: r.reason for r in rejected_questions(asked).collect()}
    assert reasons == {3: "question is empty", 4: "answer is empty", 5: "dataset name is empty"}


def test_one_question_with_most_steps(spark, tmp_path):
    asked = spark.createDataFrame([(1, "q", "a", "d")], QUESTIONS)
    steps = spark.range(1, 5001).select(
        F.lit(1).cast("bigint").alias("question_id"), F.col("id").cast("int").alias("seq"), F.lit("t").alias("tool"),
        F.lit("{}").alias("arguments"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"))
    write_reports(report_documents(asked, steps, "2026-09-15 10:30:00"), str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("report=1_20260915_103000_q.md/*.txt"))
    body = "".join(file.read_text() for file in files)
    places = [body.index(f"### {seq}. ") for seq in range(1, 5001)]
    assert len(files) == 1 and places == sorted(places) and body.startswith("# Analysis Report")


@pytest.mark.parametrize("text, expected", [
    ("Why did Sales decrease?", "why_did_sales_decrease"), ("../../etc/passwd", "etc_passwd"), ("a--b__c", "a--b__c"),
    ("__x__", "x"), ("  ", "default"), ("été 2026!", "t_2026"), ("y" * 90, "y" * 70),
])
def test_slug(spark, text, expected):
    assert spark.range(1).select(slug(F.lit(text), "default", 70)).first()[0] == expected


def test_financials_and_overrides(spark):
    lines = spark.sql("""SELECT * FROM VALUES (1, 'Laptop', 2, 900.00, 0.05), (2, 'Chair', 3, 250.55, 0.0), (3, 'Unknown', 1, 10.0, 0.0)
                         AS t(order_id, product, quantity, unit_price, discount)""")
    ratios = spark.sql("SELECT * FROM VALUES ('Laptop', 0.76), ('Chair', 0.62) AS t(product, cost_ratio)")
    derived = derive_financials(lines, ratios, "product")
    rows = {r.order_id: (r.revenue, r.cost, r.profit) for r in derived.collect()}
    assert rows[1] == (Decimal("1710.00"), Decimal("1368.00"), Decimal("342.00"))
    assert rows[2] == (Decimal("751.65"), Decimal("466.02"), Decimal("285.63"))
    assert rows[3] == (Decimal("10.00"), None, None)
    changes = spark.sql("SELECT * FROM VALUES (2, 10), (77, 5) AS t(order_id, quantity)")
    updated = {r.order_id: (r.quantity, r.revenue, r.profit) for r in apply_overrides(derived, changes, "order_id").collect()}
    assert updated == {1: (2, rows[1][0], rows[1][2]), 2: (10, Decimal("2505.50"), Decimal("952.09")), 3: (1, Decimal("10.00"), None)}
    with pytest.raises(ColumnError):
        derive_financials(lines.drop("discount"), ratios, "product")


def test_repeated_lookup_keys_are_an_error(spark):
    lines = spark.sql("SELECT 'a' AS product, 2 AS quantity, 10.0 AS unit_price, 0.0 AS discount")
    ratios = spark.sql("SELECT * FROM VALUES ('a', 0.5), ('a', 0.6) AS t(product, cost_ratio)")
    with pytest.raises(Exception, match="product is not unique: a"):
        derive_financials(lines, ratios, "product").collect()
    changes = spark.sql("SELECT * FROM VALUES ('a', 3), ('a', 4) AS t(product, quantity)")
    whole = derive_financials(lines, ratios.limit(1), "product")
    with pytest.raises(Exception, match="product is not unique: a"):
        apply_overrides(whole, changes, "product").collect()
