"""Reading and writing the flat sales table."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import SourceError
from ledgerscope.functions.columns import quoted, time_column
from ledgerscope.functions.labels import time_label
from ledgerscope.sources.dates import promote_dates

# Cell texts that mean "missing" in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cell texts that make a column boolean, and the shapes of numbers.
BOOLEAN_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")
INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

MONTH_PARTITION = "sales_month"


def read_sales(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    null_tokens: Iterable[str] = NULL_TOKENS,
    multiline: bool = False,
) -> DataFrame:
    """Load the table with typed columns and promoted date columns.

    With ``multiline`` quoted cells of a CSV may hold line breaks, and each file is one task. Without it files are
    split, and a row whose number of cells does not fit, as a line break in a cell makes it, is an error.

    Give ``schema`` for a large CSV: without it the types are inferred, which
    reads the whole input once more.
    """
    if fmt == "parquet":
        df = _load(lambda: spark.read.parquet(path), path)
        _require_content(df)
        return df
    if fmt != "csv":
        raise SourceError(f"unsupported format {fmt}; use csv or parquet")
    if PurePosixPath(path).suffix.lower() not in (".csv", ""):
        raise SourceError(f"not a .csv file: {path}")
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    reader = reader.option("mode", "FAILFAST").option("columnPruning", False)
    text = _load(lambda: reader.csv(path), path)
    _require_content(text)
    text = text.select(*(_without_tokens(name, null_tokens) for name in text.columns))
    typed = _cast(text, schema) if schema is not None else _infer(text)
    return promote_dates(typed)


def _load(reader, path: str) -> DataFrame:
    try:
        return reader()
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error}") from error


def _require_content(df: DataFrame) -> None:
    if not df.columns:
        raise SourceError("the dataset has no columns")
    if df.isEmpty():
        raise SourceError("the dataset is empty")


def _without_tokens(name: str, tokens: Iterable[str]) -> Column:
    cell = quoted(name)
    return F.when(~cell.isin(*tokens), cell).alias(name)


def _cast(text: DataFrame, schema: T.StructType | str) -> DataFrame:
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    missing = [field.name for field in declared.fields if field.name not in text.columns]
    if missing:
        raise SourceError(f"columns missing from the file: {', '.join(missing)}")
    return text.select(*(quoted(field.name).cast(field.dataType).alias(field.name) for field in declared.fields))


def _infer(text: DataFrame) -> DataFrame:
    """Narrowest type that fits every non-null cell, from one aggregate over all columns."""
    checks = []
    for position, name in enumerate(text.columns):
        cell = quoted(name)
        checks += [
            F.count(cell).alias(f"filled_{position}"),
            F.count_if(cell.isin(*BOOLEAN_TOKENS)).alias(f"boolean_{position}"),
            F.count(F.when(cell.rlike(INTEGER), F.trim(cell).try_cast("bigint"))).alias(f"bigint_{position}"),
            F.count_if(cell.rlike(NUMBER)).alias(f"double_{position}"),
        ]
    found = text.agg(*checks).first()
    columns = []
    for position, name in enumerate(text.columns):
        filled = found[f"filled_{position}"]
        fitting = [t for t in ("boolean", "bigint", "double") if found[f"{t}_{position}"] == filled]
        target = "double" if filled == 0 else (fitting + ["string"])[0]
        cell = quoted(name) if target == "string" else F.trim(quoted(name)).cast(target)
        columns.append(cell.alias(name))
    return text.select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the table as CSV with a header, one file per task."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_sales(df: DataFrame, path: str, time_col: str | None = None, mode: str = "errorifexists") -> None:
    """Write the flat table as Parquet partitioned by month.

    The rebalance lets adaptive execution split a month that holds much of the
    data and join small ones, so no task writes a whole hot month. Period
    filters prune the written folders through ``month_col=MONTH_PARTITION``.
    """
    month = time_label("month", quoted(time_column(df, time_col)))
    (
        df.withColumn(MONTH_PARTITION, month)
        .hint("rebalance", MONTH_PARTITION)
        .write.mode(mode)
        .partitionBy(MONTH_PARTITION)
        .parquet(path)
    )


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`write_sales`; the partition column stays text."""
    schema = _load(lambda: spark.read.parquet(path), path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == MONTH_PARTITION else f.dataType) for f in schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)
