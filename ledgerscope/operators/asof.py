"""As-of join: each row with the latest row of another table at or before its time.

Both tables are merged by key and band of time; within a band a window carries the last value on, and the last value of each
band goes to the bands after it. A key that holds most rows is split by its bands, so no task gets a key whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.errors import ColumnError
from ledgerscope.functions.columns import quoted
from ledgerscope.operators.bands import ROWS, banded


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str],
    times: tuple[str, str],
    columns: dict[str, str],
    strict: bool = False,
    rows: int = ROWS,
) -> DataFrame:
    """``left`` with the ``columns`` (name in ``right``: name in the result) of the latest right row at or before its time.

    ``keys`` maps columns of ``left`` to those of ``right``, ``times`` are the two time columns; with ``strict`` only rows before its time
    count. Of right rows at the same time the one with the largest columns, in the order given, counts. A left row
    without key or time, or with nothing before it, stays with nulls. Right rows without key or time match nothing.
    """
    taken = {name.lower() for name in left.columns}
    clashing = [name for name in columns.values() if name.lower() in taken]
    if clashing:
        raise ColumnError(f"columns are in both tables: {', '.join(clashing)}")
    missing = [n for n in [*keys, times[0]] if n not in left.columns] + [n for n in [*keys.values(), times[1], *columns] if n not in right.columns]
    if missing:
        raise ColumnError(f"no such column: {', '.join(missing)}")

    whole = F.struct(*(quoted(c) for c in left.columns))
    found = F.struct(quoted(times[1]).alias("at"), *(quoted(name).alias(f"f{i}") for i, name in enumerate(columns)))
    key_names = [f"key {i}" for i in range(len(keys))]
    ours = left.select(whole.alias("row"), *(quoted(k).alias(n) for k, n in zip(keys, key_names)), quoted(times[0]).alias("time"))
    theirs = right.select(found.alias("found"), *(quoted(k).alias(n) for k, n in zip(keys.values(), key_names)), quoted(times[1]).alias("time"))
    complete = " and ".join(f"`{n}` is not null" for n in [*key_names, "time"])
    bare = ours.where(f"not ({complete})")
    row_type, found_type = ours.schema["row"].dataType, theirs.schema["found"].dataType

    ours, theirs = banded([(ours.where(complete), "time"), (theirs.where(complete), "time")], rows)
    side = [*(F.col(f"`{n}`") for n in key_names), "band", "time"]
    both = ours.select(*side, F.lit(0 if strict else 1).alias("turn"), "row", F.lit(None).cast(found_type).alias("found")).union(
        theirs.select(*side, F.lit(1 if strict else 0), F.lit(None).cast(row_type), "found")
    )
    group = [*(f"`{n}`" for n in key_names), "band"]
    upto = Window.partitionBy(*group).orderBy("time", "turn", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("near", F.last("found", ignorenulls=True).over(upto)).where(F.col("row").isNotNull())
    # A row for each band in which a key occurs, with the last right row of the bands before.
    lasts = both.groupBy(*group).agg(F.max("found").alias("last"))
    earlier = Window.partitionBy(*group[:-1]).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*group, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    joined = within.join(carried, [*key_names, "band"])
    result = joined.select("row", F.coalesce("near", "carried").alias("found")).union(bare.select("row", F.lit(None).cast(found_type)))
    return result.select("row.*", *(F.col(f"found.f{i}").alias(name) for i, name in enumerate(columns.values())))
