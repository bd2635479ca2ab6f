import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.change import compare_periods, largest_decline, period_change



def table(spark, rows):
    return spark.createDataFrame(rows, "d string, category string, r string").selectExpr(
        "CAST(d AS TIMESTAMP_NTZ) AS order_date", "category", "CAST(r AS DECIMAL(18,2)) AS revenue")


def test_change_over_present_months(spark):
    """March is missing, April sums to 0, one date is null."""
    df = table(spark, [("2026-01-01", "a", "100"), ("2026-02-01", "a", "150"), ("2026-04-01", "a", "0"),
                       ("2026-05-09", "a", "30"), (None, "a", "60")])
    rows = [(r.group, float(r.value), r.percentage_change) for r in period_change(df, "revenue", "month").collect()]
    assert rows == [("2026-01", 100, None), ("2026-02", 150, 50.0), ("2026-04", 0, -100.0), ("2026-05", 30, None), (None, 60, 100.0)]


KEYS = {
    "string": [f"k{i:05d}" for i in range(3000)],
    "string, uneven": ["", "a", "ab", "abc", "abcdefgh", "b", "é", "日"],
    "bigint": list(range(-50, 3000, 7)),
    "double": [-1e300, -2.5, 0.0, 0.1, 7.0, 1e18, float("inf"), float("nan")],
    "boolean": [False, True],
    "string, one": ["x"],
}


@pytest.mark.parametrize("kind", KEYS)
def test_any_column(spark, kind):
    numbers = random.Random(4)
    sums = {key: numbers.randint(1, 999) for key in KEYS[kind]}
    rows = [(k, v) for k, v in sums.items()] + [(None, 77)]
    df = spark.createDataFrame(rows, f"k {kind.split(',')[0]}, v bigint").repartition(6)
    found = [tuple(r) for r in period_change(df, "v", "k").collect()]
    expected, previous = [], None
    for key in KEYS[kind] + [None]:
        value = 77 if key is None else sums[key]
        expected.append((key, value, None if previous is None else (value / previous - 1) * 100))
        previous = value
    assert [r[1:] for r in found] == [r[1:] for r in expected]
    assert found[-1][0] is None and (kind[0] != "s" or found == expected)


GOLDEN = [
    ("2026-07-03", "Electronics", "999"), ("2026-08-01", "Electronics", "400.00"), ("2026-08-31 23:59:59", "Electronics", "100.00"),
    ("2026-08-10", "Furniture", "200.00"), ("2026-09-01", "Electronics", "375.00"), ("2026-09-02", "Furniture", "250.00"),
    ("2026-09-30 23:00:00", "Office", "10.00"), (None, "Office", "5.00"),
]


def test_comparison_golden(spark):
    rows = compare_periods(table(spark, GOLDEN), "revenue", "category").collect()
    assert [(r.group, float(r.previous_value), float(r.latest_value), float(r.change), r.percentage_change) for r in rows] == [
        ("Electronics", 500, 375, -125, -25.0), ("Office", 0, 10, 10, None), ("Furniture", 200, 250, 50, 25.0),
    ]
    assert largest_decline(table(spark, GOLDEN), "revenue", "category").first()["group"] == "Electronics"


def test_comparison_by_quarter(spark):
    df = table(spark, GOLDEN + [("2026-02-01", "Furniture", "1")])
    rows = {r.group: (float(r.previous_value), float(r.latest_value)) for r in compare_periods(df, "revenue", "category", "quarter").collect()}
    assert rows == {"Electronics": (0, 1874), "Furniture": (1, 450), "Office": (0, 10)}


def test_one_period_has_no_comparison(spark):
    assert compare_periods(table(spark, GOLDEN[:1]), "revenue", "category").count() == 0


def test_comparison_reads_the_table_once(spark, tmp_path):
    table(spark, GOLDEN).write.parquet(str(tmp_path / "sales"))
    df = compare_periods(spark.read.parquet(str(tmp_path / "sales")), "revenue", "category")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    scans = {line.split("FileScan parquet [")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet" in line}
    assert len({scan.count(",") for scan in scans}) == 1  # the same columns wherever it is read, so that the exchange is shared


def test_hot_group(spark):
    """A third of the rows share a month and a category."""
    df = spark.range(30_000).select(
        F.expr("CAST(DATE '2026-01-01' + CAST(IF(id % 3 = 0, 40, id % 59) AS INT) AS TIMESTAMP_NTZ)").alias("order_date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("category"),
        F.lit(1).alias("revenue"),
    )
    rows = compare_periods(df, "revenue", "category").collect()
    assert sum(r.previous_value + r.latest_value for r in rows) == 30_000
    assert {r.group: r.latest_value for r in rows}["hot"] == 10_000
