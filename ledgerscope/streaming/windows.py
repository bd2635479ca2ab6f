"""Event-time windows and sessions of a stream, with a watermark for late rows.

The same functions take a table or a stream. A stream gives a window or session once, when the watermark (the latest
time seen, less the allowed delay) has passed its end; rows that come later than that are dropped. :func:`append_to` runs a stream over what is
there now and ends; its checkpoint lets the next run go on where this one ended, and a run that was broken off gives no row twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import quoted
from ledgerscope.operators.bands import ROWS, banded


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """``rows`` with a watermark on ``event_time_``; rows without a time belong to no window and go."""
    if time not in rows.columns:
        raise ColumnError(f"no such column: {time}")
    if not isinstance(rows.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ColumnError(f"{time} is no time")
    timed = rows.withColumn("event_time_", quoted(time).cast("timestamp")).where(F.col("event_time_").isNotNull())
    return timed.withWatermark("event_time_", late)


def windowed(rows: DataFrame, time: str, width: str, late: str, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """``starts``, ``ends``, the ``by`` columns and the ``totals`` (aggregates by name) of each window of ``width``."""
    window = F.window("event_time_", width)
    grouped = _timed(rows, time, late).groupBy(window.alias("window"), *(quoted(c) for c in by))
    sums = grouped.agg(*(total.alias(name) for name, total in totals.items()))
    return sums.select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), *(quoted(c) for c in by), *totals)


def sessions(rows: DataFrame, time: str, gap: str, late: str, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """``starts``, ``ends`` (the last row's time and ``gap``), the ``by`` columns and the ``totals`` of each session.

    A row within ``gap`` of the one before it, by ``by``, belongs to its session. Sessions are merged within tasks
    before the shuffle where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set. For a table with a
    hot key use :func:`session_table`, which splits it.
    """
    session = F.session_window("event_time_", gap)
    grouped = _timed(rows, time, late).groupBy(session.alias("session"), *(quoted(c) for c in by))
    sums = grouped.agg(*(total.alias(name) for name, total in totals.items()))
    return sums.select(F.col("session.start").alias("starts"), F.col("session.end").alias("ends"), *(quoted(c) for c in by), *totals)


def session_table(rows: DataFrame, time: str, gap_seconds: float, by: list[str], totals: dict[str, Column], per_band: int = ROWS) -> DataFrame:
    """As :func:`sessions`, of a table: every key is cut into bands of time, so that one with most of the rows is spread over tasks.

    A band takes the last time of the bands before it, which says whether its first row opens a session, and then the
    start of the session that is open where it begins. Totals are summed by key and start, with partial sums before the shuffle.
    """
    names = [f"key {i}" for i in range(len(by))]
    whole = F.struct(*(quoted(c) for c in rows.columns)).alias("row")
    keyed = rows.select(whole, *(quoted(c).alias(n) for c, n in zip(by, names)), quoted(time).cast("timestamp").alias("at")).where("at is not null")
    split = banded([(keyed, "at")], per_band)[0]
    keys = [F.coalesce(F.to_json(F.struct(*(f"`{n}`" for n in names))), F.lit("")).alias("key")] if names else [F.lit("").alias("key")]
    split = split.select("row", "at", "band", *keys)
    here, earlier = Window.partitionBy("key", "band"), Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)

    def carried(frame: DataFrame, value: Column, name: str) -> DataFrame:
        """``frame`` with the last value that is not null of the bands before, one row for each key and band."""
        ends = frame.groupBy("key", "band").agg(F.max(value).alias("value"))
        return frame.join(ends.select("key", "band", F.last("value", ignorenulls=True).over(earlier).alias(name)), ["key", "band"])

    known = carried(split, F.col("at"), "before band")
    previous = F.coalesce(F.lag("at").over(here.orderBy("at")), "before band")
    apart = F.unix_micros("at") - F.unix_micros(previous) >= int(gap_seconds * 1_000_000)
    opened = known.withColumn("opens", F.when(previous.isNull() | apart, F.col("at")))
    starts = carried(opened, F.col("opens"), "open before")
    start = F.coalesce(F.max("opens").over(here.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "open before")
    placed = starts.select("row.*", "key", F.col("at").alias("event_time_"), start.alias("session start"))
    grouped = placed.groupBy("key", "session start", *(quoted(c) for c in by))
    ends = F.timestamp_micros(F.unix_micros(F.max("event_time_")) + int(gap_seconds * 1_000_000))
    sums = grouped.agg(ends.alias("session end"), *(total.alias(name) for name, total in totals.items()))
    return sums.select(F.col("session start").alias("starts"), F.col("session end").alias("ends"), *(quoted(c) for c in by), *totals)


def append_to(result: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream ``result`` over all rows there are now and adds what is complete to the Parquet table ``path``."""
    writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start(path)
    query.awaitTermination()
