"""The dataset profile: size, types, missing cells, duplicates, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import OperationError
from ledgerscope.functions.columns import numeric, present, quoted, time_columns
from ledgerscope.operators.filters import preview
from ledgerscope.operators.median import exact_median
from ledgerscope.operators.statistics import mean

SAMPLE_LIMIT = 20


def _per_column(totals: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row with ``{field}_{i}`` columns into a row per profiled column."""
    structs = [
        F.struct(F.lit(name).alias("column"), *(F.col(f"{field}_{i}").cast(kind).alias(field) for field, kind in fields.items()))
        for i, name in enumerate(columns)
    ]
    if not structs:
        schema = "column string" + "".join(f", `{field}` {kind}" for field, kind in fields.items())
        return totals.sparkSession.createDataFrame([], schema)
    return totals.select(F.inline(F.array(*structs)))


def profile_header(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Row and column counts. For a view of which ``df`` has only some columns, ``columns`` says how many it has."""
    return df.agg(F.count("*").alias("rows"), F.lit(columns or len(df.columns)).cast("bigint").alias("columns"))


def profile_types(df: DataFrame) -> DataFrame:
    """Type and number of filled cells of each column."""
    totals = df.agg(
        *(F.lit(kind).alias(f"data_type_{i}") for i, (_, kind) in enumerate(df.dtypes)),
        *(F.count(present(df, name)).alias(f"filled_{i}") for i, name in enumerate(df.columns)),
    )
    return _per_column(totals, df.columns, {"data_type": "string", "filled": "bigint"})


def profile_missing(df: DataFrame) -> DataFrame:
    """Missing cells per column, all columns in one aggregate."""
    totals = df.agg(*(F.count_if(present(df, name).isNull()).alias(f"missing_{i}") for i, name in enumerate(df.columns)))
    return _per_column(totals, df.columns, {"missing": "bigint"})


def profile_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows after the first copy, and rows after the first with the same key.

    Equal rows are merged before the shuffle, and the key counts are taken from
    the merged rows, so the table is read once. Null equals null. The key count
    is null if there is no such column.
    """
    copies = df.groupBy(*(quoted(name) for name in df.columns)).agg(F.count("*").alias("__copies"))
    if key is None or key not in df.columns:
        return copies.agg(
            F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
            F.lit(None).cast("bigint").alias("duplicate_keys"),
        )
    by_key = copies.groupBy(quoted(key)).agg(F.sum("__copies").alias("__rows"), F.count("*").alias("__distinct"))
    return by_key.agg(
        F.coalesce(F.sum(F.col("__rows") - F.col("__distinct")), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def profile_dates(df: DataFrame) -> DataFrame:
    """Earliest and latest moment of each date or timestamp column, as ISO text."""
    columns = time_columns(df)
    totals = df.agg(
        F.count("*").alias("rows"),
        *(_iso(F.min(quoted(name))).alias(f"min_{i}") for i, name in enumerate(columns)),
        *(_iso(F.max(quoted(name))).alias(f"max_{i}") for i, name in enumerate(columns)),
    )
    return _per_column(totals, columns, {"min": "string", "max": "string"})


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def profile_numeric(df: DataFrame) -> DataFrame:
    """Count, min, max, mean and exact median of each numeric column.

    One pass takes all but the medians. For those the columns are stacked under
    their numbers, so all medians come from one grouped operator with one group
    per column.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(columns):
        value = numeric(df, name)
        aggregates += [
            F.count(value).alias(f"count_{i}"), F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}"),
            mean(value, df.schema[name].dataType).alias(f"mean_{i}"),
        ]
    fields = {"count": "bigint", "min": "double", "max": "double", "mean": "double"}
    summary = _per_column(df.agg(*aggregates), columns, fields)
    if not columns:
        return summary.withColumn("median", F.lit(None).cast("double"))
    pairs = [part for i, name in enumerate(columns) for part in (F.lit(i), numeric(df, name).cast("double"))]
    long = df.select(F.stack(F.lit(len(columns)), *pairs).alias("number", "value"))
    medians = exact_median(long, "value", ["number"], few_groups=True)
    names = F.element_at(F.array(*(F.lit(name) for name in columns)), F.col("number") + 1)
    medians = medians.select(names.alias("column"), "median")
    return summary.join(F.broadcast(medians), "column", "left")


def profile_sample(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    if not 0 <= n <= SAMPLE_LIMIT:
        raise OperationError(f"a sample shows 0 to {SAMPLE_LIMIT} rows, not {n}")
    return preview(df, order_by, n) if n else df.limit(0)
