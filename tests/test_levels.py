from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.operators.lattice import subtotals
from ledgerscope.operators.snapshots import snapshot_difference

SALES = [("a", "x", 1, 5), ("a", "x", 1, None), ("a", None, 2, 7), (None, "x", None, 1), (None, None, 1, 2), ("b", "y", 3, None)]


def plain(rows, levels):
    groups = defaultdict(list)
    for a, b, who, value in rows:
        for level in levels:
            groups[None if level & 2 else a, None if level & 1 else b, level].append((who, value))
    for (a, b, level), own in groups.items():
        values = [v for _, v in own if v is not None]
        yield a, b, level, len(own), sum(values) if values else None, len({w for w, _ in own if w is not None})


@pytest.mark.parametrize("kind, levels", [("cube", [0, 1, 2, 3]), ("rollup", [0, 1, 3])])
def test_subtotals_tell_totals_from_null_groups(spark, kind, levels):
    df = spark.createDataFrame(SALES, "a string, b string, who long, value long")
    found = subtotals(df, ["a", "b"], {"value": "total"}, ("who", "people"), kind).select("a", "b", "level", "rows", "total", "people")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(SALES, levels)))


def test_a_hot_group_is_one_row_a_task(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("a"), (F.col("id") % 5).alias("v"))
    found = subtotals(df, ["a"], {"v": "total"}, ("v", "kinds")).collect()
    assert sorted((r["level"], r["rows"], r["total"], r["kinds"]) for r in found) == [(0, 10_000, 20_000, 5), (1, 10_000, 20_000, 5)]


def test_subtotals_of_nothing_and_refusals(spark):
    df = spark.createDataFrame(SALES, "a string, b string, who long, value long")
    assert [(r["level"], r["rows"], r["total"]) for r in subtotals(df.limit(0), ["a"], {"value": "total"}).collect()] in ([], [(1, 0, None)])
    for by, sums, kind in ((["a"], {"value": "A"}, "cube"), ([], {}, "cube"), (["a"], {}, "sets")):
        with pytest.raises(ColumnError):
            subtotals(df, by, sums, kind=kind)


VERSION = st.tuples(st.sampled_from([None, 1, 1, 2]), st.sampled_from([None, "", "u", "v"]), st.sampled_from([None, 0, 1]))


def plain_difference(old, new):
    for key in {r[0] for r in old + new}:
        before, after = (Counter(r for r in rows if r[0] == key) for rows in (old, new))
        gone, come = sum((before - after).values()), sum((after - before).values())
        if gone or come:
            kind = "added" if not before else "removed" if not after else "changed"
            columns = ""
            if kind == "changed" and gone == come:
                values = [[Counter({}) for _ in range(2)] for _ in range(2)]
                for side, rows in enumerate((before, after)):
                    for row, n in rows.items():
                        for at in (0, 1):
                            values[at][side][row[at + 1]] += n
                columns = ",".join(name for name, (a, b) in zip(("s", "n"), values) if a != b)
            yield key, kind, come, gone, columns


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VERSION, max_size=12), st.lists(VERSION, max_size=12))
def test_difference_equals_counters(spark, old, new):
    schema = "k long, s string, n long"
    found = snapshot_difference(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k"]).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_difference(old, new)))


def test_a_hot_key_and_values_that_change_places(spark):
    old = spark.range(5000).select(F.lit(1).alias("k"), F.lit("a").alias("x"), F.lit("b").alias("y")).union(spark.createDataFrame([(2, "p", "q")], "k int, x string, y string"))
    new = old.withColumns({"x": F.when(F.col("k") == 2, "q").otherwise(F.col("x")), "y": F.when(F.col("k") == 2, "p").otherwise(F.col("y"))}).union(old.limit(1))
    found = snapshot_difference(old, new, ["k"]).collect()
    assert sorted(map(tuple, found)) == [(1, "changed", 1, 0, ""), (2, "changed", 1, 1, "x,y")]
    with pytest.raises(ColumnError):
        snapshot_difference(old, new.drop("y"), ["k"])
    with pytest.raises(ColumnError):
        snapshot_difference(old, new, ["none"])
