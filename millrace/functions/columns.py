"""Column references and the type buckets every operator uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Column by its literal name; dots and backticks in the name are kept."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIMES)


def is_feature(dtype: T.DataType) -> bool:
    """Numbers and flags enter a feature matrix as they are."""
    return is_number(dtype) or isinstance(dtype, T.BooleanType)


def is_flat(dtype: T.DataType) -> bool:
    return not isinstance(dtype, NESTED)


def names(df: DataFrame, test: Callable[[T.DataType], bool]) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def number_names(df: DataFrame) -> list[str]:
    return names(df, is_number)


def text_names(df: DataFrame) -> list[str]:
    return names(df, is_text)


def present(df: DataFrame, columns: Iterable[str], skip: str | None = None) -> list[str]:
    """The requested columns that exist, in request order, without ``skip``."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(columns) if c in have and c != skip]


def null_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every float column, so one missing value remains."""
    floats = names(df, lambda t: isinstance(t, (T.FloatType, T.DoubleType)))
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def safe_name(name: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; every other character becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]
