from datetime import date, datetime
from decimal import Decimal

import pytest

from ledgerscope.errors import ColumnError, EmptyResultError, LiteralError, OperationError, PeriodError
from ledgerscope.functions.periods import distinct_periods, latest_periods, parse_period, period_filter
from ledgerscope.operators.filters import filter_rows, match_count, preview


@pytest.fixture(scope="module")
def rows(spark):
    return spark.sql("""
        SELECT * FROM VALUES
        (1, 'Phone', 5L, TIMESTAMP_NTZ '2026-01-05 00:00:00', 0.5D, CAST(1.10 AS DECIMAL(12,2)), true),
        (2, 'headPHONES', 7L, TIMESTAMP_NTZ '2026-02-01 12:30:00', CAST('NaN' AS DOUBLE), CAST(2.20 AS DECIMAL(12,2)), false),
        (3, 'a.c', NULL, NULL, NULL, NULL, NULL),
        (4, NULL, 12L, TIMESTAMP_NTZ '2025-02-28 23:59:59', 2.0D, CAST(1.10 AS DECIMAL(12,2)), true),
        (5, 'ÉTÉ abc', 5L, TIMESTAMP_NTZ '2026-02-28 23:59:59', 0.5D, CAST(9 AS DECIMAL(12,2)), true)
        AS t(id, s, n, d, x, m, f)""")


def ids(df):
    return sorted(row.id for row in df.collect())


@pytest.mark.parametrize("column, operator, value, expected", [
    ("s", "equals", "Phone", [1]),
    ("s", " Not_Equals ", "Phone", [2, 3, 4, 5]),
    ("n", "equals", 5, [1, 5]),
    ("n", "equals", 5.0, [1, 5]),
    ("n", "equals", 5.5, []),
    ("n", "not_equals", 5, [2, 3, 4]),
    ("n", "greater_than", 5, [2, 4]),
    ("n", "greater_than", 6.5, [2, 4]),
    ("n", "greater_than_or_equal", 5, [1, 2, 4, 5]),
    ("n", "less_than", 7, [1, 5]),
    ("n", "less_than_or_equal", 7, [1, 2, 5]),
    ("x", "greater_than", 0.5, [4]),
    ("x", "greater_than_or_equal", 0.5, [1, 4, 5]),
    ("x", "not_equals", 0.5, [2, 3, 4]),
    ("x", "equals", float("nan"), []),
    ("m", "equals", 1.1, [1, 4]),
    ("m", "equals", Decimal("2.2"), [2]),
    ("f", "equals", True, [1, 4, 5]),
    ("f", "equals", 0, [2]),
    ("d", "greater_than", "2026-01-05", [2, 5]),
    ("d", "greater_than_or_equal", date(2026, 1, 5), [1, 2, 5]),
    ("d", "less_than", "2026", [4]),
    ("d", "greater_than_or_equal", "2026-02", [2, 5]),
    ("d", "equals", datetime(2026, 2, 1, 12, 30), [2]),
    ("s", "equals", 5, []),
    ("s", "not_equals", 5, [1, 2, 3, 4, 5]),
    ("n", "equals", "5", []),
    ("d", "equals", "not a date", []),
    ("n", "not_equals", None, [1, 2, 3, 4, 5]),
    ("s", "contains", "phone", [1, 2]),
    ("s", "contains", "A.C$", [3, 5]),
    ("s", "contains", r"a\.C", [3]),
    ("s", "contains", "^a.c$|b", [3, 5]),
    ("s", "contains", "été", [5]),
    ("n", "contains", 2, [4]),
    ("d", "contains", "2026-02", [2, 5]),
    ("s", "contains", "nan|null", []),
])
def test_filter(rows, column, operator, value, expected):
    assert ids(filter_rows(rows, column, operator, value)) == expected
    assert match_count(rows, column, operator, value).first()[0] == len(expected)


@pytest.mark.parametrize("column, value", [("n", "5"), ("s", 5), ("d", "soon"), ("n", None), ("s", None)])
def test_wrong_kind_cannot_be_ordered(rows, column, value):
    with pytest.raises(LiteralError):
        filter_rows(rows, column, "less_than", value)


def test_refusals(rows):
    with pytest.raises(OperationError):
        filter_rows(rows, "n", "between", 5)
    with pytest.raises(ColumnError):
        filter_rows(rows, "absent", "equals", 5)
    for n in (0, 101):
        with pytest.raises(OperationError):
            preview(rows, ["id"], n)


def test_preview(rows):
    assert [row.id for row in preview(rows, ["n", "id"], 3).collect()] == [1, 5, 2]
    assert preview(rows, ["n", "id"], 100).collect()[-1].id == 3


def test_filter_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def plan(frame):
        return frame.select("id")._jdf.queryExecution().executedPlan().toString()

    assert "GreaterThan(n,5)" in plan(filter_rows(df, "n", "greater_than", 5.0))
    assert "EqualTo(m,1.10)" in plan(filter_rows(df, "m", "equals", 1.1))
    assert "GreaterThan(x,0.5)" in plan(filter_rows(df, "x", "greater_than", 0.5))
    assert "GreaterThanOrEqual(d,2026-02-01T00:00), LessThan(d,2026-03-01T00:00)" in plan(period_filter(df, "February 2026"))


@pytest.mark.parametrize("period, expected", [
    ("2026", [1, 2, 5]), (" 2026 ", [1, 2, 5]), ("2026-02", [2, 5]), ("2026-2", [2, 5]), ("February", [2, 4, 5]),
    ("fEBRUARY", [2, 4, 5]), ("February 2026", [2, 5]), ("feb 2026", [2, 5]), ("2026-02-15", [2, 5]),
    ("February 3, 2026", [2, 5]), ("2/3/2026", [2, 5]), ("2031", []), (None, [1, 2, 3, 4, 5]), ("", [1, 2, 3, 4, 5]), ("  ", [1, 2, 3, 4, 5]),
])
def test_period(rows, period, expected):
    assert ids(period_filter(rows, period)) == expected


def test_period_on_dates(spark):
    df = spark.sql("SELECT id, DATE '2026-01-31' + CAST(id AS INT) AS day FROM range(3)")
    assert ids(period_filter(df, "2026-02")) == [1, 2]
    df = spark.sql("SELECT id, TIMESTAMP '2026-01-31 12:00:00' + MAKE_DT_INTERVAL(CAST(id AS INT)) AS at FROM range(3)")
    assert ids(period_filter(df, "2026-02")) == [1, 2]


@pytest.mark.parametrize("text", ["2026Q3", "soon", "2026-13", "0000", "20261", "Smarch 2026"])
def test_unsupported_periods(text):
    with pytest.raises(PeriodError):
        parse_period(text)


def test_period_needs_a_time_column(rows):
    with pytest.raises(ColumnError):
        period_filter(rows.select("id", "n"), "2026")
    assert period_filter(rows.select("id", "n"), None).count() == 5
    with pytest.raises(EmptyResultError):
        period_filter(rows, "2031", require_rows=True)


def test_last_year(spark):
    assert parse_period("9999").end is None
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '9999-12-31 00:00:00' AS d")
    assert ids(period_filter(df, "9999")) == [1] and ids(period_filter(df, "9999-12")) == [1]


def test_periods_that_occur(rows):
    assert [tuple(r) for r in distinct_periods(rows).collect()] == [("2025-02", 1), ("2026-01", 1), ("2026-02", 2)]
    assert [tuple(r) for r in latest_periods(rows, 2).collect()] == [("2026-02", 2), ("2026-01", 1)]
    assert [tuple(r) for r in latest_periods(rows, 5, "quarter").collect()] == [("2026Q1", 3), ("2025Q1", 1)]


def test_contains_reads_plain_text(spark):
    df = spark.sql("SELECT CAST('2026-01-05 00:00:00' AS TIMESTAMP_NTZ) AS t, CAST(45.5 AS DECIMAL(18,4)) AS d, CAST(12345678 AS DOUBLE) AS x, CAST(7 AS DECIMAL(9,2)) AS w")
    for column, pattern in (("t", "2026-01-05$"), ("d", "^45[.]5$"), ("x", "^12345678"), ("w", "^7$")):
        assert filter_rows(df, column, "contains", pattern).count() == 1


def test_offsets_become_utc(spark):
    df = spark.sql("SELECT CAST('2026-01-04 22:00:00' AS TIMESTAMP_NTZ) AS t")
    assert filter_rows(df, "t", "equals", "2026-01-05T00:00:00+02:00").count() == 1
    assert filter_rows(df, "t", "equals", "2026-01-05T00:00:00").count() == 0


@pytest.mark.parametrize("text", ["20260915", "2026-09-15T10:30:00Z", "2026-09-15 10:30", "09/2026", "2026.09.15"])
def test_further_period_texts(text):
    assert parse_period(text) == parse_period("2026-09")
