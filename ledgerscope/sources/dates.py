"""Promotion of text columns that hold dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.columns import quoted

# Accepted date shapes and their ISO form.
DATE_SHAPES = (
    (r"^(\d{4}-\d{1,2}-\d{1,2})$", "$1"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}) (\d{2}:\d{2}:\d{2})$", "$1 $2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{2}:\d{2}:\d{2})$", "$1 $2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{2}:\d{2}:\d{2}\.\d{1,6})$", "$1 $2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{2}:\d{2})$", "$1 $2:00"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{2}:\d{2})$", "$3-$1-$2 $4:00"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$1-$2 $4"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3 $4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
)
# Shapes with an offset, which become UTC, and with the name of the month.
OFFSET_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$"
MONTH_NAME_SHAPES = ((r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"))
SHAPES = (*DATE_SHAPES, (OFFSET_SHAPE, None), *MONTH_NAME_SHAPES)


def is_date_name(name: str) -> bool:
    lowered = name.lower()
    return "date" in lowered or lowered.endswith("_time") or lowered == "timestamp"


def parsed_date(cell: Column, shape: tuple[str, str | None]) -> Column:
    """The timestamp of a text in one date shape, or null."""
    pattern, iso = shape
    trimmed = F.trim(cell)
    if shape in MONTH_NAME_SHAPES:
        return F.try_to_timestamp(F.when(trimmed.rlike(pattern), trimmed), F.lit(iso)).cast("date").cast("timestamp_ntz")
    if iso is None:
        moment = F.when(trimmed.rlike(pattern), F.regexp_replace(trimmed, r"([+-]\d{2})(\d{2})$", "$1:$2")).try_cast("timestamp")
        seconds = (F.unix_micros(moment).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.when(trimmed.rlike(pattern), F.regexp_replace(trimmed, pattern, iso)).try_cast("timestamp_ntz")


def promote_dates(df: DataFrame) -> DataFrame:
    """Turn date-named text columns into timestamps where one shape fits every non-null cell.

    One aggregate decides for all such columns; a column with mixed shapes or
    one bad value stays text, and so does one without any value.
    """
    candidates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and is_date_name(f.name)]
    if not candidates:
        return df
    counts = []
    for position, name in enumerate(candidates):
        counts.append(F.count(quoted(name)).alias(f"filled_{position}"))
        counts += [
            F.count(parsed_date(quoted(name), shape)).alias(f"shape_{position}_{number}")
            for number, shape in enumerate(SHAPES)
        ]
    found = df.agg(*counts).first()
    promoted = {}
    for position, name in enumerate(candidates):
        filled = found[f"filled_{position}"]
        for number, shape in enumerate(SHAPES):
            if filled and found[f"shape_{position}_{number}"] == filled:
                promoted[name] = parsed_date(quoted(name), shape)
                break
    return df.withColumns(promoted) if promoted else df
