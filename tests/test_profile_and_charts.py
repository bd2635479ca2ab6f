import pytest
from pyspark.errors import PySparkException

from ledgerscope.errors import ColumnError, EmptyResultError, OperationError
from ledgerscope.functions.labels import axis_label, with_period
from ledgerscope.operators.charts import chart_points, chart_series, scatter_points
from ledgerscope.operators.constraints import check_constraints
from ledgerscope.operators.profile import (
    profile_dates, profile_duplicates, profile_header, profile_missing, profile_numeric, profile_sample, profile_types,
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.sql("""
        SELECT * FROM VALUES
        (1L, TIMESTAMP_NTZ '2026-01-05 10:11:12', 2.0D, CAST(NULL AS INT), 'a', true),
        (1L, TIMESTAMP_NTZ '2026-01-05 10:11:12', 2.0D, CAST(NULL AS INT), 'a', true),
        (1L, NULL, CAST('NaN' AS DOUBLE), CAST(NULL AS INT), 'b', true),
        (NULL, TIMESTAMP_NTZ '2025-01-05 00:00:00', 5.5D, CAST(NULL AS INT), NULL, false),
        (NULL, TIMESTAMP_NTZ '2025-01-05 00:00:00', 5.5D, CAST(NULL AS INT), NULL, false)
        AS t(order_id, order_date, x, nothing, s, flag)""")


def as_dict(df):
    return {row[0]: tuple(row)[1:] for row in df.collect()}


def test_profile(table):
    assert tuple(profile_header(table).first()) == (5, 6)
    assert as_dict(profile_missing(table)) == {"order_id": (2,), "order_date": (1,), "x": (1,), "nothing": (5,), "s": (2,), "flag": (0,)}
    assert as_dict(profile_types(table))["order_date"] == ("timestamp_ntz", 4)
    assert as_dict(profile_dates(table)) == {"order_date": ("2025-01-05T00:00:00", "2026-01-05T10:11:12")}
    assert as_dict(profile_numeric(table)) == {
        "order_id": (3, 1.0, 1.0, 1.0, 1.0), "x": (4, 2.0, 5.5, 3.75, 3.75), "nothing": (0, None, None, None, None),
    }


def test_duplicates(table):
    assert tuple(profile_duplicates(table, "order_id").first()) == (2, 3)
    assert tuple(profile_duplicates(table, "absent").first()) == (2, None)
    assert tuple(profile_duplicates(table.limit(0), "order_id").first()) == (0, 0)


def test_empty_and_narrow_tables(table):
    empty = table.limit(0)
    assert as_dict(profile_numeric(empty))["x"] == (0, None, None, None, None)
    assert as_dict(profile_dates(empty)) == {"order_date": (None, None)}
    assert profile_numeric(table.select("s")).count() == 0
    assert profile_dates(table.select("s")).count() == 0


def test_sample(table):
    assert profile_sample(table, ["x", "s"], 2).count() == 2
    assert profile_sample(table, ["x"], 0).count() == 0
    with pytest.raises(OperationError):
        profile_sample(table, ["x"], 21)


def test_constraints(table):
    rows = {r.constraint: (r.violations, r.passed) for r in check_constraints(table, ["order_id", "gone"], "order_id", ["x", "flag", "gone"], 6, 10).collect()}
    assert rows == {
        "required columns": (1, False), "rows between 6 and 10": (1, False), "unique order_id": (3, False),
        "no missing x": (1, False), "no missing flag": (0, True),
    }


@pytest.fixture(scope="module")
def points(spark):
    return spark.sql("""
        SELECT * FROM VALUES (TIMESTAMP_NTZ '2026-02-01 00:00:00', 'b', 3.0D, 1), (TIMESTAMP_NTZ '2026-01-01 00:00:00', 'a', 1.0D, 2),
        (TIMESTAMP_NTZ '2026-01-09 00:00:00', 'b', NULL, 3), (NULL, NULL, 4.0D, 4) AS t(order_date, k, y, n)""")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_series(points):
    assert rows(chart_series(points, "Line", "month", "y")) == [("2026-01", 1.0), ("2026-02", 3.0), (None, 4.0)]
    assert rows(chart_series(points, "bar", "k", "y", "count")) == [("a", 1), ("b", 1), (None, 1)]
    assert rows(chart_series(points, "bar", "k", "y", "median", period="2026-01")) == [("a", 1.0), ("b", None)]
    assert rows(chart_series(points, "pie", "k", "y")) == [("a", 1.0, 12.5), ("b", 3.0, 37.5), (None, 4.0, 50.0)]


def test_scatter(points):
    assert rows(scatter_points(points, "n", "y").orderBy("x")) == [(1, 3.0), (2, 1.0), (4, 4.0)]
    assert rows(chart_points(scatter_points(points, "n", "y"), 2)) == [("1", 3.0, 3), ("2", 1.0, 3)]


def test_chart_refusals(points):
    with pytest.raises(OperationError):
        chart_series(points, "radar", "k", "y")
    with pytest.raises(OperationError):
        chart_series(points, "bar", "k", "y", "std")
    with pytest.raises(ColumnError):
        chart_series(points, "bar", "k", "k", "count")
    with pytest.raises(ColumnError):
        scatter_points(points, "k", "y")
    with pytest.raises(EmptyResultError):
        scatter_points(points, "n", "y", period="2030", require_rows=True)
    with pytest.raises(OperationError):
        chart_points(scatter_points(points, "n", "y"), 101)
    with pytest.raises(PySparkException, match="negative slice"):
        chart_series(points.selectExpr("k", "-y AS y"), "pie", "k", "y").collect()


def test_labels(points):
    labels = [r.period for r in with_period(points, "quarter").orderBy("n").collect()]
    assert labels == ["2026Q1", "2026Q1", "2026Q1", None]
    assert axis_label("unit_price") == "Unit Price"
