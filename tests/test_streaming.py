from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.streaming.windows import append_to, session_table, sessions, windowed

START = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp_ntz, g string"


def counted():
    return {"n": F.count("*")}


class Feed:
    """A folder of event files that a stream reads, and the table it writes."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.number = spark, folder, 0

    def add(self, *minutes):
        rows = [(m, None if m is None else START + timedelta(minutes=m), "a") for m in minutes]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, build):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        append_to(build(stream), f"{self.folder}/out", f"{self.folder}/checkpoint")
        found = self.spark.read.parquet(f"{self.folder}/out").orderBy("starts").collect()
        return [((row["starts"] - START) / timedelta(minutes=1), row["n"]) for row in found]


def hourly(rows):
    return windowed(rows, "ts", "1 hour", "30 minutes", ["g"], counted())


def test_windows_close_by_the_watermark_and_late_rows_go(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(5, 10, 70)
    assert feed.run(hourly) == []  # the watermark stands at minute 40
    feed.add(59, 80, 95)  # minute 59 comes late but in time; the watermark goes to minute 65
    assert feed.run(hourly) == [(0, 3)]
    feed.add(20, None, 190)  # minute 20 comes too late
    assert feed.run(hourly) == [(0, 3), (60, 3)]


def test_a_restart_gives_no_row_twice(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(5, 70, 130)
    first = feed.run(hourly)
    assert first == [(0, 1)]
    assert feed.run(hourly) == first and feed.run(hourly) == first
    feed.add(250)
    assert feed.run(hourly) == [(0, 1), (60, 1), (120, 1)]


def test_a_broken_run_is_done_again(spark, tmp_path):
    """The first run fails after it has read a file; the next one starts from the checkpoint and gives each window once."""
    feed = Feed(spark, tmp_path)
    feed.add(5, 70, 200)
    broken = lambda rows: hourly(rows.withColumn("g", F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.col("g"))))
    with pytest.raises(Exception, match="broken"):
        feed.run(broken)
    assert feed.run(hourly) == [(0, 1), (60, 1)]


def test_sessions_merge_across_runs(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    build = lambda rows: sessions(rows, "ts", "10 minutes", "30 minutes", ["g"], counted())
    feed.add(0, 16)
    assert feed.run(build) == []
    feed.add(8, 100)  # joins both
    assert feed.run(build) == [(0, 3)]


def test_stream_equals_table(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    minutes = [(7 * i * i) % 600 for i in range(60)]
    feed.add(*minutes)
    feed.add(2000)
    table = spark.read.parquet(f"{tmp_path}/in").where("id < 2000")
    expected = [((r["starts"] - START) / timedelta(minutes=1), r["n"]) for r in hourly(table).orderBy("starts").collect()]
    assert feed.run(hourly) == expected


def plain_sessions(rows, gap):
    out = {}
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if last is None or t - last >= gap:
                start = t
            last = t
            n, _ = out.get((key, start), (0, 0))
            out[key, start] = n + 1, t + gap
    return sorted((str(k), s, e, n) for (k, s), (n, e) in out.items())


@pytest.mark.parametrize("per_band", [2, 1000])
def test_session_table_equals_plain_sessions(spark, per_band):
    """Nulls, ties, repeated rows and a hot key, also where every band has two rows."""
    rows = [(None if i % 11 == 0 else i % 3 // 2, None if i % 13 == 0 else (i * i * 37) % 500) for i in range(120)] * 2
    df = spark.createDataFrame([(k, None if t is None else START + timedelta(seconds=t)) for k, t in rows], "k long, ts timestamp_ntz")
    found = session_table(df, "ts", 5, ["k"], counted(), per_band).collect()
    seconds = lambda t: int((t - START).total_seconds())
    assert sorted((str(r["k"]), seconds(r["starts"]), seconds(r["ends"]), r["n"]) for r in found) == plain_sessions(rows, 5)
    assert session_table(df.limit(0), "ts", 5, ["k"], counted()).collect() == []


def test_refusals(spark):
    df = spark.createDataFrame([(1, "x")], "ts long, g string")
    for name in ("ts", "none"):
        with pytest.raises(ColumnError):
            windowed(df, name, "1 hour", "1 hour", [], counted())
