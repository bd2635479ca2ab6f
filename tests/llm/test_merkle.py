import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import merkle
from ledgerscope.llm.queries import QUERIES
from oracle import connect, difference


def stored(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, length long, digest string")


def rows_of(audit):
    return {(r["file"], r["offset"], r["status"]) for r in audit.collect()}


@pytest.fixture()
def archive(monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 100)
    monkeypatch.setattr(merkle, "FANOUT", 5)
    return [(f, 40 * i, 40, f"{f}-{i}") for f in range(12) for i in range(30)]


def test_finds_each_damage(spark, archive):
    pick = random.Random(2)
    hurt, lost = set(pick.sample(archive, 9)), set(pick.sample(archive, 5))
    replica = [(f, o, n, "bad" if (f, o, n, d) in hurt else d) for f, o, n, d in archive if (f, o, n, d) not in lost] + [(3, 5000, 1, "new")]
    expected = {(f, o, "missing") for f, o, _, _ in lost} | {(f, o, "corrupt") for f, o, _, _ in hurt - lost} | {(3, 5000, "extra")}
    assert rows_of(merkle.audit(stored(spark, archive), stored(spark, replica))) == expected


def test_equal_replicas_and_empty_tables(spark, archive):
    table, none = stored(spark, archive), stored(spark, [])
    assert rows_of(merkle.audit(table, table.repartition(5))) == set()
    assert rows_of(merkle.audit(none, none)) == set()
    assert len(rows_of(merkle.audit(none, table))) == len(archive)


def test_one_root(spark, archive):
    levels = merkle.tree(stored(spark, archive), 12)
    assert levels[-1].count() == 1
    counts = [level.count() for level in levels]
    assert counts == sorted(counts, reverse=True)


def test_layout(spark):
    rows = [(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, "é", "日" * 5000), (2, "é", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    record = merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    records = pages.select("page_id", "url", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    placed = merkle.layout(records, file_bytes=8000).collect()
    assert sorted(r["copies"] for r in placed) == [1, 1, 1, 2]
    for file in {r["file"] for r in placed}:
        end = 0
        for r in sorted((r for r in placed if r["file"] == file), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]


def test_query_against_sql(spark):
    query = QUERIES["op5_merkle_audit"]
    assert difference(query.build(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), query.sql) is None
