"""Column checks made against the schema, so a bad request fails without a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.errors import ColumnError

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ColumnError(f"no such column: {', '.join(missing)}; the table has {', '.join(df.columns)}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, name)
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers, and booleans counted as 0 and 1."""
    return isinstance(data_type(df, name), (T.NumericType, T.BooleanType))


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a number; NaN counts as missing, as null does."""
    dtype = data_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return quoted(name).cast("int")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(quoted(name), F.lit(None).cast(dtype))
    if isinstance(dtype, T.NumericType):
        return quoted(name)
    raise ColumnError(f"column {name} must be numeric, it is {dtype.simpleString()}")


def present(df: DataFrame, name: str) -> Column:
    """The column of any type, with NaN as null."""
    return numeric(df, name) if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)) else quoted(name)


def time_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, TIME_TYPES)]


def time_column(df: DataFrame, time_col: str | None = None) -> str:
    """The named time column, or the first one in schema order."""
    if time_col is not None:
        if not isinstance(data_type(df, time_col), TIME_TYPES):
            raise ColumnError(f"column {time_col} is not a date or timestamp")
        return time_col
    found = time_columns(df)
    if not found:
        raise ColumnError("the table has no date or timestamp column")
    return found[0]
