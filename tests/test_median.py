import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.operators.median import BANDS, SLICES, exact_median, value_band, value_slice

EDGES = [0.0, -0.0, 1.0, 2.0, 0.5, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, 3.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3)]
EDGES += [2.0**k for k in range(-60, 60, 7)] + [math.nextafter(2.0**k, 0) for k in range(-60, 60, 7)]


def numbers_at_all_scales():
    numbers = random.Random(1)
    values = EDGES + [numbers.uniform(-10, 10) * 10 ** numbers.randint(-12, 12) for _ in range(3000)]
    return sorted(values + [math.nextafter(v, math.inf) for v in values if math.isfinite(v)])


def test_bands_never_fall(spark):
    values = [-math.inf, *numbers_at_all_scales(), math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_band("v").alias("b"))
    bands = [row.b for row in sorted(rows.collect(), key=lambda row: row.v)]
    assert bands == sorted(bands)


@pytest.mark.parametrize("lowest, highest", [(-20.0, 1000.0), (5.0, math.nextafter(5.0, 6)), (-1e308, 1.7e308), (1.0, math.inf), (3.0, 3.0)])
def test_slices_never_fall(spark, lowest, highest):
    inside = [v for v in [*numbers_at_all_scales(), lowest, highest] if lowest <= v <= highest]
    rows = spark.createDataFrame([(v, lowest, highest) for v in inside], "v double, a double, z double")
    found = rows.select("v", value_slice("v", "a", "z").alias("s")).collect()
    slices = [row.s for row in sorted(found, key=lambda row: row.v)]
    assert slices == sorted(slices) and slices[-1] <= SLICES


@pytest.mark.parametrize("few", [True, False])
def test_grouped(spark, few):
    numbers = random.Random(2)
    data = []
    for group, size in [("odd", 101), ("even", 100), ("one", 1), ("two", 2), (None, 7), ("hot", 4000)]:
        data += [(group, round(numbers.lognormvariate(3, 2) - 20, 2)) for _ in range(size)]
    data += [("empty", None), ("empty", None), ("partly", None), ("partly", 4.0), ("same", 7.5), ("same", 7.5), ("same", 7.5)]
    data += [("far apart", -1e12), ("far apart", 3e12), ("hot", None), ("endless", 1.0), ("endless", math.inf), ("endless", math.inf)]
    data += [("both ends", -math.inf), ("both ends", 4.0), ("both ends", 5.0), ("both ends", math.inf)]
    df = spark.createDataFrame(data, "k string, v double")
    found = {row.k: row.median for row in exact_median(df, "v", ["k"], few).collect()}
    expected = {}
    for group in {k for k, _ in data}:
        values = [v for k, v in data if k == group and v is not None]
        expected[group] = statistics.median(values) if values else None
    assert found == expected


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e15, 1e15), st.integers(-50, 50).map(float), st.sampled_from(EDGES[:8])), min_size=1, max_size=60))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
    assert exact_median(df, "v").first()["median"] == (low + high) / 2


def test_decimals_and_integers(spark):
    df = spark.sql("SELECT CAST(id AS DECIMAL(18,4)) / 8 AS d, id AS i FROM range(1000)")
    assert exact_median(df, "d").first()["median"] == 62.4375
    assert exact_median(df, "i").first()["median"] == 499.5


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_median(df, "v", ["k"]).count() == 0
    assert exact_median(df, "v").first()["median"] is None


@pytest.mark.parametrize("start, width", [(1.0, 1000.0), (1.7e15, 8.64e10), (-0.001, 1e-9)])
def test_last_window_holds_few_values(spark, start, width):
    """Of 200,000 distinct values, also close together far from zero, few share a slice of the middle band."""
    df = spark.range(200_000).select((F.rand(3) * width + start).alias("v"))
    bands = df.select("v", value_band("v").alias("b"))
    middle = bands.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy(F.desc("n")).first()
    inside = bands.where(F.col("b") == middle.b).select("v", F.lit(middle.a).alias("a"), F.lit(middle.z).alias("z"))
    assert bands.select("b").distinct().count() < 11 * BANDS
    assert inside.groupBy(value_slice("v", "a", "z")).count().agg(F.max("count")).first()[0] < 20
    assert exact_median(df, "v").first()["median"] == statistics.median(row.v for row in df.select("v").collect())
