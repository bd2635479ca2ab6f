from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.operators.asof import asof_join
from ledgerscope.operators.bands import banded
from ledgerscope.operators.intervals import interval_join
from ledgerscope.operators.ordered import moving_average, ranks, running_totals, top_rows

START = datetime(2024, 1, 1)
LEFT, RIGHT = "k long, t long, x long", "k2 long, t2 long, v string"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def plain_asof(left, right, strict):
    for k, t, x in left:
        seen = [(t2, v is not None, v or "") for k2, t2, v in right if k is not None and k2 == k and t is not None and t2 is not None and (t2 < t if strict else t2 <= t)]
        best = max(seen, default=None)
        yield k, t, x, best and (best[2] if best[1] else None), best and best[0]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.sampled_from([None, *range(12)]), st.integers(0, 3)), max_size=25),
    st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.sampled_from([None, *range(12)]), st.sampled_from(["a", "b", None])), max_size=25),
    st.booleans(),
)
def test_asof_equals_a_plain_search(spark, left, right, strict):
    """Nulls, ties and repeated rows, in bands of three rows."""
    found = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), {"k": "k2"}, ("t", "t2"), {"v": "v", "t2": "at"}, strict, rows=3)
    assert rows_of(found) == sorted(map(repr, plain_asof(left, right, strict)))


def test_asof_splits_a_hot_key(spark):
    """One key has all rows; its last value crosses many bands without a right row, and no task gets most of them."""
    left = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, 5, "first"), (1, 15_000, "second")], RIGHT)
    bands = banded([(left, "t"), (right, "t2")], 1000)[0]
    assert bands.groupBy("band").count().agg(F.max("count")).first()[0] <= 1100
    found = asof_join(left, right, {"k": "k2"}, ("t", "t2"), {"v": "v"}, rows=1000).groupBy("v").count().collect()
    assert {row["v"]: row["count"] for row in found} == {None: 5, "first": 14_995, "second": 5_000}


def test_asof_of_times_and_refusals(spark):
    times = spark.createDataFrame([(1, START), (1, START + timedelta(hours=2))], "k long, t timestamp_ntz")
    right = spark.createDataFrame([(1, START + timedelta(hours=1))], "k2 long, t2 timestamp_ntz")
    assert [row["at"] for row in asof_join(times, right, {"k": "k2"}, ("t", "t2"), {"t2": "at"}).orderBy("t").collect()] == [None, START + timedelta(hours=1)]
    with pytest.raises(ColumnError):
        asof_join(times, right, {"k": "k2"}, ("t", "t2"), {"t2": "T"})
    with pytest.raises(ColumnError):
        asof_join(times, right, {"none": "k2"}, ("t", "t2"), {"t2": "at"})
    assert asof_join(times.limit(0), right.limit(0), {"k": "k2"}, ("t", "t2"), {"t2": "at"}).collect() == []


def test_bands_hold_for_odd_numbers(spark):
    numbers = [None, float("nan"), float("inf"), float("-inf"), -1e300, 0.0, 1.0, 1e300]
    df = spark.createDataFrame([(n,) for n in numbers * 3], "x double")
    found = banded([(df, "x")], 2)[0].collect()
    key = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    found = sorted(((key(row["x"]), row["band"]) for row in found))
    assert [band for _, band in found] == sorted(band for _, band in found) and len(found) == 24


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.sampled_from([None, *range(-20, 20)])), max_size=25),
    st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.sampled_from([None, *range(-20, 20)]), st.sampled_from([-1, 0, 1, 5, 37])), max_size=20),
    st.booleans(),
)
def test_intervals_equal_all_pairs(spark, points, spans, open_start):
    """Short and long intervals, empty and reversed ones, with buckets split after two points."""
    spans = [(k, s, None if s is None else s + d) for k, s, d in spans]
    found = interval_join(
        spark.createDataFrame(points, "k long, t long"), spark.createDataFrame(spans, "k2 long, s long, e long"), {"k": "k2"}, "t", ("s", "e"), 2, open_start, split=2
    )
    expected = [
        (k, t, k2, s, e) for k, t in points for k2, s, e in spans
        if k is not None and k == k2 and t is not None and s is not None and (s < t if open_start else s <= t) and t <= e
    ]
    assert rows_of(found) == sorted(map(repr, expected))


def test_a_crowded_bucket_is_split(spark):
    points = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    spans = spark.createDataFrame([(1, 0, 2999), (1, 10, 12)], "k2 int, s long, e long")
    assert interval_join(points, spans, {"k": "k2"}, "t", ("s", "e"), 1e6, split=100).count() == 3003
    with pytest.raises(ColumnError):
        interval_join(points, points, {"k": "k"}, "t", ("t", "t"), 1)


ROWS = [(1, 3, 5, "a"), (2, 1, None, "b"), (3, 1, 7, "a"), (4, None, 2, None), (5, 3, 5, "a"), (5, 3, 5, "a"), (6, 2, 1, "b")]


def test_running_totals_by_group_and_over_all(spark):
    df = spark.createDataFrame(ROWS, "id long, t long, v long, g string")
    found = running_totals(df, ["t"], {"v": "upto"}, number="n").orderBy("n").collect()
    assert [(r["id"], r["upto"]) for r in found] == [(4, 2), (2, 2), (3, 9), (6, 10), (1, 15), (5, 20), (5, 25)]
    found = running_totals(df, ["t"], {"v": "upto"}, ["g"]).collect()
    assert sorted((r["id"], r["upto"]) for r in found) == [(1, 12), (2, 0), (3, 7), (4, 2), (5, 17), (5, 22), (6, 1)]
    assert running_totals(df.limit(0), ["t"], {"v": "upto"}).collect() == []
    with pytest.raises(ColumnError):
        running_totals(df, ["t"], {"v": "ID"})


def test_ranges_of_one_key_add_up(spark):
    """All rows have the same group and time, so the ranges are told apart by the other columns."""
    df = spark.range(5000).select(F.col("id"), F.lit(1).alias("t"), F.lit("g").alias("g"), F.col("id").alias("v"))
    totals = running_totals(df, ["t"], {"v": "upto"}, ["g"], "n")
    assert totals.where("upto <> n * (n - 1) / 2").count() == 0 and totals.count() == 5000
    means = moving_average(df, ["t"], "v", 3000, "mean", ["g"])  # frames over several ranges
    assert means.where("mean <> (id + greatest(id - 2999, 0)) / 2").count() == 0


def test_moving_average_of_nulls(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, None), (4, 6), (5, 8)], "t long, v long")
    assert [r["mean"] for r in moving_average(df, ["t"], "v", 2, "mean").orderBy("t").collect()] == [2.0, 2.0, None, 6.0, 7.0]
    with pytest.raises(ColumnError):
        moving_average(df, ["t"], "v", 0, "mean")


def test_ranks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [5, 5, None, 1, None, 9, 5]], "v long")
    found = {r["v"]: (r["rank"], r["dense_rank"], r["percent_rank"]) for r in ranks(df, "v").collect()}
    assert found == {1: (1, 1, 0.0), 5: (2, 2, 1 / 6), 9: (5, 3, 4 / 6), None: (6, 4, 5 / 6)}
    found = {r["v"]: r["rank"] for r in ranks(df, "v", descending=True).collect()}
    assert found == {9: 1, 5: 2, 1: 5, None: 6}
    assert ranks(df.limit(1), "v").collect()[0]["percent_rank"] == 0.0
    assert ranks(df.limit(0), "v").collect() == []


def test_top_rows(spark):
    df = spark.createDataFrame(ROWS, "id long, t long, v long, g string")
    found = top_rows(df, "g", [F.col("v").desc_nulls_last()], 2).collect()
    assert sorted((r["g"] or "", r["place"], r["id"]) for r in found) == [("", 1, 4), ("a", 1, 3), ("a", 2, 1), ("b", 1, 6), ("b", 2, 2)]
