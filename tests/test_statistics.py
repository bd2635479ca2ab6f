"""Statistics, group aggregates and the null rules."""

import pytest

from ledgerscope.errors import AnalysisInputError, ColumnError, EmptyResultError, OperationError
from ledgerscope.operators.shares import deviations, missing_by, pivot_sum, ratio_by, share_of_total
from ledgerscope.operators.statistics import GROUP_AGGREGATIONS, group_aggregate, rows_analyzed, statistics, summarize


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("b", 1.0), ("b", 3.0), ("b", None), ("a", None), ("c", 4.0), (None, 2.0), ("d", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.fixture(scope="module")
def dated(spark):
    return spark.sql("""
        SELECT * FROM VALUES (TIMESTAMP_NTZ '2026-01-05 10:00:00', 'x', 10), (TIMESTAMP_NTZ '2026-02-05 00:00:00', 'y', 20),
        (TIMESTAMP_NTZ '2025-12-31 23:59:59', 'x', 5), (TIMESTAMP_NTZ '2026-02-28 23:59:59', 'x', 7), (NULL, 'x', 1)
        AS t(order_date, region, quantity)""")


def pairs(df):
    return [tuple(row) for row in df.collect()]


def test_groups_ascend_with_null_last(groups):
    assert pairs(statistics(groups, "sum", "v", "k")) == [("a", 0.0), ("b", 4.0), ("c", 4.0), ("d", 0.0), (None, 2.0)]


def test_empty_group(groups):
    for operation in ("mean", "median", "min", "max", "std"):
        found = dict(pairs(statistics(groups, operation, "v", "k")))
        assert found["a"] is None and found["d"] is None
    assert dict(pairs(statistics(groups, "std", "v", "k")))["c"] is None  # one row has no sample deviation
    assert dict(pairs(statistics(groups, "count", "v", "k"))) == {"a": 0, "b": 2, "c": 1, "d": 0, None: 1}
    assert dict(pairs(statistics(groups, " Median ", "v", "k")))["b"] == 2.0


def test_global(groups):
    row = summarize(groups, "v").first().asDict()
    assert row == {"mean": 2.5, "median": 2.5, "sum": 10.0, "min": 1.0, "max": 4.0, "std": pytest.approx(1.2909944), "count": 4}
    assert statistics(groups.where("k = 'a'"), "sum", "v").first()["value"] == 0
    assert statistics(groups, "count", "k").first()["value"] == 6


def test_time_words(dated):
    assert pairs(statistics(dated, "sum", "quantity", " Month ")) == [("2025-12", 5), ("2026-01", 10), ("2026-02", 27), (None, 1)]
    assert pairs(statistics(dated, "count", "quantity", "quarter")) == [("2025Q4", 1), ("2026Q1", 3), (None, 1)]
    assert pairs(statistics(dated, "max", "quantity", "YEAR")) == [("2025", 5), ("2026", 20), (None, 1)]
    assert pairs(statistics(dated, "median", "quantity", "month")) == [("2025-12", 5.0), ("2026-01", 10.0), ("2026-02", 13.5), (None, 1.0)]


def test_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(10, 1), (9, 1), (100, 1)], "k int, v int")
    assert pairs(statistics(df, "sum", "v", "k")) == [("9", 1), ("10", 1), ("100", 1)]


def test_booleans_count_as_numbers(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "flag boolean")
    assert statistics(df, "sum", "flag").first()["value"] == 2


def test_refusals(groups, dated):
    with pytest.raises(OperationError):
        statistics(groups, "mode", "v")
    with pytest.raises(ColumnError):
        statistics(groups, "sum", "nothing")
    with pytest.raises(ColumnError):
        statistics(groups, "sum", "k")
    with pytest.raises(OperationError):
        statistics(groups, "percentage_change", "v")
    with pytest.raises(ColumnError):
        statistics(groups, "sum", "v", "month")
    with pytest.raises(ColumnError):
        group_aggregate(groups, "nothing", "v")
    with pytest.raises(ColumnError):
        group_aggregate(groups, "k", "nothing")
    with pytest.raises(OperationError):
        group_aggregate(groups, "k", "v", "std")
    with pytest.raises(EmptyResultError):
        group_aggregate(dated, "region", "quantity", period="2031", require_rows=True)
    assert issubclass(OperationError, AnalysisInputError)


def test_group_aggregate_order(groups):
    assert pairs(group_aggregate(groups, "k", "v", "mean")) == [("c", 4.0), ("b", 2.0), (None, 2.0), ("a", None), ("d", None)]
    assert pairs(group_aggregate(groups, "k", "v", "mean", descending=False)) == [("b", 2.0), (None, 2.0), ("c", 4.0), ("a", None), ("d", None)]
    assert set(GROUP_AGGREGATIONS) == {"sum", "mean", "median", "min", "max", "count"}


def test_group_aggregate_in_period(dated):
    result = group_aggregate(dated, "region", "quantity", period="February 2026")
    assert pairs(result.withColumn("rows", rows_analyzed(dated, "February 2026"))) == [("y", 20, 2), ("x", 7, 2)]


def test_decimal_mean_is_exact(spark):
    df = spark.sql("SELECT CAST(0.1 AS DECIMAL(18,4)) AS v FROM range(1000)")
    assert statistics(df, "mean", "v").first()["value"] == 0.1


def test_ratio_of_sums(spark):
    df = spark.createDataFrame([("n", 100.0, 10.0), ("n", 300.0, 90.0), ("s", 50.0, 20.0), ("z", 0.0, 1.0)], "region string, revenue double, profit double")
    rows = pairs(ratio_by(df, "profit", "revenue", "region", "margin"))
    assert rows == [("s", 50.0, 20.0, 40.0), ("n", 400.0, 100.0, 25.0), ("z", 0.0, 1.0, None)]


def test_share(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "k string, v int")
    assert pairs(share_of_total(df, "v", "k")) == [("b", 3, 75.0), ("a", 1, 25.0)]


def test_pivot(dated):
    assert pairs(pivot_sum(dated, "quantity", "region", "month", ["2026-01", "2026-02"])) == [("x", 10, 7), ("y", 0, 20)]
    assert pairs(pivot_sum(dated, "quantity", "region", "quarter", ["2025Q4", "2026Q1"])) == [("x", 5, 17), ("y", 0, 20)]
    assert pairs(pivot_sum(dated, "quantity", "month", "region", ["y"])) == [("2026-02", 20)]


def test_deviations(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 1, 1, 1, 11]], "v double")
    assert [row.v for row in deviations(df, "v", 2).collect()] == [11.0]
    assert deviations(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v", 0).count() == 0


def test_missing_by(dated):
    df = dated.selectExpr("*", "IF(quantity > 10, NULL, 0.05D) AS discount")
    assert pairs(missing_by(df, "discount", ["region", "month"])) == [
        ("x", "2025-12", 1, 0), ("x", "2026-01", 1, 0), ("x", "2026-02", 1, 0), ("x", None, 1, 0), ("y", "2026-02", 1, 1),
    ]
