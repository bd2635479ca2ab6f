import os

import pytest
from pyspark.sql import functions as F

from ledgerscope.errors import SourceError
from ledgerscope.plans.reports import BAND, report_documents, report_pieces, write_report_files
from ledgerscope.sources.text_files import write_pieces

GENERATED = "2026-09-15 10:30:00"


def read(folder):
    return {name: (folder / name).read_text() for name in os.listdir(folder)}


def made(spark, questions, steps):
    asked = spark.createDataFrame(questions, "question_id long, question string, answer string, dataset string")
    done = spark.createDataFrame(steps, "question_id long, seq long, tool string, arguments string, status string, message string")
    return report_documents(asked, done, GENERATED)


def test_one_file_per_report(spark, tmp_path):
    questions = [(1, "Why?", "Because.", "sales"), (2, "Why?", "Other.", "sales"), (3, None, "x", "sales"), (4, "é ?", "ü", "sales")]
    steps = [(1, 2, "b", None, "error", None), (1, 1, "a", "{}", "success", None), (1, None, "late", "{}", "success", None), (1, 2, "a", "{}", "success", None), (9, 1, "x", "{}", "success", None)]
    documents = made(spark, questions, steps)
    write_report_files(documents, str(tmp_path / "out"))
    files = read(tmp_path / "out")
    assert set(files) == {"20260915_103000_why.md", "20260915_103000_why_2.md", "20260915_103000_analysis_report.md"}
    tools = [line for line in files["20260915_103000_why.md"].splitlines() if line.startswith("### ")]
    assert tools == ["### 1. `a`", "### 2. `a`", "### 2. `b`", "### –. `late`"]
    assert files["20260915_103000_why_2.md"].endswith("No analytical tools were used.\n")
    blocks = documents.orderBy("question_id", F.col("seq").asc_nulls_last(), "block").where("question_id = 1 and block is not null").collect()
    assert files["20260915_103000_why.md"] == "".join(row["block"] for row in blocks)


def test_a_long_report_is_written_by_many_tasks(spark, tmp_path):
    """One report holds nearly all blocks; its bands are placed and written apart, and no task gets them all."""
    many = BAND * 2 + 10
    documents = spark.range(many).select(
        F.lit(1).cast("long").alias("question_id"), F.col("id").alias("seq"), F.lit("long.md").alias("filename"), F.concat(F.col("id").cast("string"), F.lit("é\n")).alias("block")
    )
    documents = documents.union(spark.createDataFrame([(2, 0, "short.md", "s")], documents.schema))
    pieces = report_pieces(documents)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "199")
    try:
        sizes = pieces.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(row["count"] for row in sizes) <= BAND + 11
    write_report_files(documents, str(tmp_path / "out"))
    assert read(tmp_path / "out") == {"long.md": "".join(f"{i}é\n" for i in range(many)), "short.md": "s"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.md").write_text("old")
    pieces = spark.range(100).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.lit(0).cast("long").alias("at"), F.lit("x").alias("piece"))
    broken = pieces.withColumn("piece", F.when(F.col("name") == "77.md", F.raise_error(F.lit("broken"))).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="broken"):
        write_pieces(broken, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == ["out"] and read(tmp_path / "out") == {"old.md": "old"}


def test_overlapping_or_missing_pieces_are_an_error(spark, tmp_path):
    for places in ([0, 0], [0, 5]):
        pieces = spark.createDataFrame([("a.md", at, "ab") for at in places], "name string, at long, piece string")
        with pytest.raises(Exception, match="missing or overlap"):
            write_pieces(pieces, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_append_replaces_equal_names_and_overwrite_replaces_all(spark, tmp_path):
    one = spark.createDataFrame([("a.md", 0, "1"), ("b.md", 0, "1")], "name string, at long, piece string")
    two = spark.createDataFrame([("a.md", 0, "22")], "name string, at long, piece string")
    write_pieces(one, str(tmp_path / "out"))
    write_pieces(two, f"file:{tmp_path}/out")
    assert read(tmp_path / "out") == {"a.md": "22", "b.md": "1"}
    write_pieces(two, str(tmp_path / "out"), overwrite=True)
    assert read(tmp_path / "out") == {"a.md": "22"}
    assert os.listdir(tmp_path) == ["out"]


def test_no_reports(spark, tmp_path):
    write_report_files(made(spark, [], []), str(tmp_path / "out"))
    assert read(tmp_path / "out") == {}


def test_refused_targets(spark):
    with pytest.raises(SourceError):
        write_pieces(spark.createDataFrame([], "name string, at long, piece string"), "s3a://bucket/out")
    with pytest.raises(SourceError):
        write_pieces(spark.range(1), "/tmp/none")
