"""Windows and sessions of the events, read as a stream and as a table.

A stream gives what the watermark has passed, two hours before the latest event; the SQL states the same. User 1 has over a third of all events.
"""

from pyspark.sql import functions as F

from ledgerscope.sources.scratch import scratch_folder
from ledgerscope.sources.star import SCHEMAS
from ledgerscope.streaming.windows import append_to, session_table, sessions, windowed
from workload.registry import register

LATE, WIDTH, GAP = "2 hours", "1 hour", "30 minutes"


def _owned(events):
    owner = F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("bigint")
    return events.select("event_id", "ts", owner.alias("user_id"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))


def _stream(spark, sf_dir):
    return _owned(spark.readStream.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet*"))  # a pattern, as a stream takes no plain file


def _ended(spark, result):
    """What the stream has given when all events are read."""
    folder = scratch_folder(spark)
    append_to(result, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")


def _naive(df):
    """Times without a zone, as the tables have them."""
    return df.withColumns({"starts": F.col("starts").cast("timestamp_ntz"), "ends": F.col("ends").cast("timestamp_ntz"), "total": F.col("total").cast("double")})


@register("stream_hourly_totals", """
WITH hours AS (SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT starts, starts + INTERVAL 1 HOUR AS ends, event_type, events, total FROM hours
WHERE starts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_hourly_totals(spark, sf_dir):
    totals = {"events": F.count("*"), "total": F.sum("value")}
    return _naive(_ended(spark, windowed(_stream(spark, sf_dir), "ts", WIDTH, LATE, ["event_type"], totals)))


SESSIONS_SQL = """
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, CAST(value AS DECIMAL(18,2)) AS value FROM events WHERE ts IS NOT NULL),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS number FROM marked),
s AS (SELECT min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, user_id, count(*) AS events, CAST(sum(value) AS DOUBLE) AS total FROM numbered GROUP BY user_id, number)
SELECT * FROM s"""


@register("stream_sessions", SESSIONS_SQL + " WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_sessions(spark, sf_dir):
    totals = {"events": F.count("*"), "total": F.sum("value")}
    return _naive(_ended(spark, sessions(_stream(spark, sf_dir), "ts", GAP, LATE, ["user_id"], totals)))


@register("session_totals", SESSIONS_SQL)
def session_totals(spark, sf_dir):
    events = _owned(spark.read.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet"))
    return _naive(session_table(events, "ts", 1800, ["user_id"], {"events": F.count("*"), "total": F.sum("value")}))
