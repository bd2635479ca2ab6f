import pytest
from pyspark.sql import functions as F

from ledgerscope.errors import SourceError
from ledgerscope.functions.periods import period_filter
from ledgerscope.sources.dates import promote_dates
from ledgerscope.operators.change import period_change
from ledgerscope.sources.star import SALES_COLUMNS, SCHEMAS, read_table, sales
from ledgerscope.sources.tables import MONTH_PARTITION, read_monthly, read_sales, write_csv, write_sales

CSV = """order_id,order_date,customer_id,discount,quantity,note,flag,code,empty
1,2026-01-05,C001,0.05,2,"said ""hi"", left",True,1d,
2,2026-01-06,C002,NA,3,,False,2d,NaN
3,2026-02-07,C003,null,2,n/a,TRUE,3d,
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_null_tokens(spark, csv_path):
    df = read_sales(spark, csv_path)
    assert dict(df.dtypes) == {
        "order_id": "bigint", "order_date": "timestamp_ntz", "customer_id": "string", "discount": "double",
        "quantity": "bigint", "note": "string", "flag": "boolean", "code": "string", "empty": "double",
    }
    rows = df.orderBy("order_id").collect()
    assert [r.discount for r in rows] == [0.05, None, None]
    assert [r.note for r in rows] == ['said "hi", left', None, None]
    assert rows[0].order_date.isoformat() == "2026-01-05T00:00:00"


def test_line_breaks_in_cells(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('a,day_date,note,n\n1,2026-01-05,"two\nlines",5\n2,2026-01-06,x,6\n')
    df = read_sales(spark, str(path), multiline=True)
    assert [r.note for r in df.orderBy("a").collect()] == ["two\nlines", "x"]
    assert dict(df.dtypes)["day_date"] == "timestamp_ntz"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_sales(spark, str(path)).collect()


@pytest.mark.parametrize("text", [
    "2026-01-31T10:00:00Z", "2026-01-31 12:00:00+02:00", "2026-01-31T12:00:00+0200", "1/31/2026 10:00", "01/31/2026 10:00:00", "2026/01/31 10:00:00",
])
def test_shapes_with_a_time(spark, text):
    row = promote_dates(spark.createDataFrame([(text,)], "day_date string")).first()
    assert row.day_date.isoformat() == "2026-01-31T10:00:00"


@pytest.mark.parametrize("text", ["20260131", "31-01-2026", "January 31, 2026", "Jan 31, 2026", "31 January 2026"])
def test_shapes_of_days(spark, text):
    row = promote_dates(spark.createDataFrame([(text,)], "day_date string")).first()
    assert row.day_date.isoformat() == "2026-01-31T00:00:00"


def test_csv_with_schema(spark, csv_path):
    df = read_sales(spark, csv_path, schema="order_id bigint, discount decimal(4,2), order_date string")
    assert df.dtypes == [("order_id", "bigint"), ("discount", "decimal(4,2)"), ("order_date", "timestamp_ntz")]
    with pytest.raises(SourceError):
        read_sales(spark, csv_path, schema="absent int")


def test_own_null_tokens(spark, csv_path):
    assert read_sales(spark, csv_path, null_tokens=["", "C001"]).where("customer_id IS NULL").count() == 1


def test_refused_sources(spark, tmp_path):
    with pytest.raises(SourceError):
        read_sales(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(SourceError):
        read_sales(spark, str(tmp_path / "sales.xlsx"))
    with pytest.raises(SourceError):
        read_sales(spark, str(tmp_path / "sales.csv"), fmt="xml")
    (tmp_path / "head.csv").write_text("a,b\n")
    with pytest.raises(SourceError, match="empty"):
        read_sales(spark, str(tmp_path / "head.csv"))
    (tmp_path / "nothing.csv").write_text("")
    with pytest.raises(SourceError, match="no columns"):
        read_sales(spark, str(tmp_path / "nothing.csv"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 0.5), (2, None, None)], "id bigint, text string, x double")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_sales(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_dates_all_or_nothing(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "2026-01-01", 5, "2026-01-02T10:00:00", "1/31/2026", None, "2026-01-01", "2026-01-01"),
         (None, "soon", 6, "2026-01-03T11:30:00", "2/1/2026", None, "2026-01-01 10:00:00", "2026-02-30")],
        "order_date string, due_date string, update_count bigint, event_time string, us_date string, no_date string, mixed_date string, bad_date string",
    )
    promoted = promote_dates(df)
    assert dict(promoted.dtypes) == {
        "order_date": "timestamp_ntz", "due_date": "string", "update_count": "bigint", "event_time": "timestamp_ntz",
        "us_date": "timestamp_ntz", "no_date": "string", "mixed_date": "string", "bad_date": "string",
    }
    assert promoted.select(F.max("us_date")).first()[0].isoformat() == "2026-02-01T00:00:00"


def test_only_date_names(spark):
    df = spark.createDataFrame([("2026-01-01", "2026-01-01", "2026-01-01")], "label string, timestamp string, time string")
    assert dict(promote_dates(df).dtypes) == {"label": "string", "timestamp": "timestamp_ntz", "time": "string"}


def test_monthly_table_prunes(spark, tmp_path):
    path = str(tmp_path / "sales")
    df = spark.sql("SELECT id AS order_id, CAST(DATE '2025-11-01' + CAST(id % 120 AS INT) AS TIMESTAMP_NTZ) AS order_date FROM range(600)")
    write_sales(df, path)
    table = read_monthly(spark, path)
    assert dict(table.dtypes)[MONTH_PARTITION] == "string"
    for period, expected in [("2026-01", 155), ("2025", 305), ("January", 155), ("December 2025", 155)]:
        kept = period_filter(table, period, "order_date", month_col=MONTH_PARTITION)
        assert kept.count() == expected == period_filter(table, period, "order_date").count()
        assert f"PartitionFilters: [isnotnull({MONTH_PARTITION}" in kept._jdf.queryExecution().executedPlan().toString() or period == "January"


DIR = "/root/testdata/sf0.001"


def test_sales_view(spark):
    whole = sales(spark, DIR)
    assert tuple(whole.columns) == SALES_COLUMNS
    assert whole.count() == read_table(spark, DIR, "lineitem").count()


def test_fewer_columns_join_fewer_tables(spark):
    for names, tables in [(("revenue",), 1), (("order_date", "revenue"), 2), (("category", "cost"), 2), (("salesperson",), 2), (("region",), 5)]:
        df = sales(spark, DIR, *names)
        assert len(df.inputFiles()) == tables
        expected = sales(spark, DIR).select(*names)
        assert df.exceptAll(expected).isEmpty() and expected.exceptAll(df).isEmpty()


def test_stated_schemas_are_those_of_the_files(spark):
    for name, ddl in SCHEMAS.items():
        found = spark.read.parquet(f"{DIR}/{name}.parquet").dtypes
        assert ", ".join(f"{column} {kind}" for column, kind in found) == ddl


def test_hot_order_is_split(spark, tmp_path):
    """A third of the lines belong to one order: the shuffled join splits its partition."""
    lines = read_table(spark, DIR, "lineitem")
    hot = lines.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, 5).otherwise(F.col("l_orderkey")))
    hot.repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    read_table(spark, DIR, "orders").write.parquet(str(tmp_path / "orders.parquet"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        result = period_change(sales(spark, str(tmp_path), "order_date", "revenue"), "revenue", "month")
        total = sum(row.value for row in result.collect())
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert "SortMergeJoin(skew=true)" in plan
    assert total == sales(spark, str(tmp_path), "revenue").agg(F.sum("revenue")).first()[0]
