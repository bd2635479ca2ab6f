import random

from pyspark.sql import functions as F

from ledgerscope.llm import kdtree
from ledgerscope.llm.queries import QUERIES


def place(spark, rows, shards, bins=None):
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)
    dims = {"size": F.col("size"), "source": kdtree.scattered(F.col("source")), "doc_id": F.col("doc_id")}
    return kdtree.kd_shards(table, dims, F.col("size"), shards, [F.col("doc_id"), F.col("source")]).collect()


def check(rows, placed, shards):
    assert sorted(map(str, ((r["doc_id"], r["source"], r["size"]) for r in placed))) == sorted(map(str, rows))
    for shard in range(shards):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(0 <= r["shard"] < shards for r in placed)


def test_near_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "BINS", 16)  # several passes
    monkeypatch.setattr(kdtree, "SLOT_ROWS", 20)
    pick = random.Random(1)
    rows = [(i, pick.choice(["a", "a", "b", "c", None]), pick.randrange(8, 400)) for i in range(600)]
    placed = place(spark, rows, 7)
    check(rows, placed, 7)
    sizes = [sum(r["size"] for r in placed if r["shard"] == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 3 * 400


def test_equal_rows_are_split(spark):
    rows = [(1, "a", 10)] * 90 + [(None, None, 10)] * 9 + [(2, "b", 500)]
    placed = place(spark, rows, 4)
    check(rows, placed, 4)
    assert max(sum(1 for r in placed if r["shard"] == s) for s in range(4)) < 60


def test_fewer_rows_than_shards(spark):
    check([(1, "a", 10), (2, "b", 20)], place(spark, [(1, "a", 10), (2, "b", 20)], 8), 8)
    assert place(spark, [], 8) == []


def test_query(spark):
    placed = QUERIES["op6_kd_tree"].build(spark, "/root/testdata/sf0.01")
    assert placed.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = [r["sum(size)"] for r in placed.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.2 * min(sizes)
