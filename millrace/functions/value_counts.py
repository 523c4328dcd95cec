"""Counts of every distinct value of many columns in one shuffle.

All columns are put in long form ``(cid, l, d, s, t)`` (one typed value field is
set), counted map-side and shuffled once by value. A value that fills a third
of a column leaves each task as one row, so it makes no hot partition.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, is_flat

SLOTS = {"l": "bigint", "d": "double", "s": "string", "t": "timestamp_ntz"}
KEY = ["cid", *SLOTS]
SKETCH_ERROR = 0.015


def _typed(field: T.StructField) -> Column:
    """Struct with the value in the field of its family: integer, float, text or time.

    Instants go by their microseconds, which unlike local time repeat for none.
    """
    c, dtype = col(field.name), field.dataType
    slot = "s"
    if isinstance(dtype, T.TimestampType):
        slot, c = "l", F.unix_micros(c)
    elif isinstance(dtype, T.IntegralType):
        slot = "l"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        slot = "d"
    elif isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        slot = "t"
    return F.struct(*[(c if k == slot else F.lit(None)).cast(t).alias(k) for k, t in SLOTS.items()])


def slot_value(row, dtype: T.DataType) -> object:
    """The Python value of a long-form row, as the column's own type."""
    value = next((row[k] for k in SLOTS if row[k] is not None), None)
    if isinstance(dtype, T.TimestampType) and value is not None:
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=value)
    if isinstance(dtype, T.DateType) and value is not None:
        return value.date()
    return value


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per non-null cell: ``cid`` is the position in ``columns``."""
    schema = df.schema
    cells = [
        F.struct(F.lit(i).alias("cid"), _typed(schema[c]).alias("v"))
        for i, c in enumerate(columns)
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.cid", *[f"cell.v.{k}" for k in SLOTS])
        .where(" OR ".join(f"{k} IS NOT NULL" for k in SLOTS))
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``cid, l, d, s, t, n``: how often each non-null value of each column occurs."""
    return long_values(df, columns).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def column_name(columns: Sequence[str], cid: str = "cid") -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(cid).cast("int") + 1)


def countable(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose values can be compared; arrays, maps and structs are left out."""
    chosen = set(df.columns if columns is None else columns)
    return [f.name for f in df.schema.fields if f.name in chosen and is_flat(f.dataType)]


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``column, n_unique`` with nulls not counted.

    ``exact=False`` takes fixed-size HyperLogLog sketches and shuffles no values.
    """
    cols = countable(df, columns)
    if not exact:
        row = df.agg(*[F.approx_count_distinct(col(c), SKETCH_ERROR).alias(f"c{i}") for i, c in enumerate(cols)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_unique"))
                 for i, c in enumerate(cols)]
        return row.select(F.inline(F.array(*cells)))
    seen = value_counts(df, cols).select("cid", F.lit(1).cast("bigint").alias("k"))
    floor = df.sparkSession.range(0, len(cols), 1, 1).select(
        F.col("id").cast("int").alias("cid"), F.lit(0).cast("bigint").alias("k"))
    return (
        seen.unionAll(floor).groupBy("cid").agg(F.sum("k").alias("n_unique"))
        .select(column_name(cols).alias("column"), "n_unique")
    )


def _counts(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, int]:
    rows = cardinality(df, columns, exact).collect() if columns else []
    found = {r["column"]: r["n_unique"] for r in rows}
    return {c: found[c] for c in columns}


def judged_cardinality(df: DataFrame, cuts: Sequence[float], columns: Sequence[str] | None = None) -> dict[str, int]:
    """Distinct counts good enough to tell on which side of every cut a column lies; for callers who ask for estimates.

    A sketch pass comes first; only columns within 10 % of a cut, some eight
    standard errors of the sketch, are counted exactly. Values of the other columns,
    usually the long ones, are never shuffled.
    """
    cols = countable(df, columns)
    if not cols:
        return {}
    found = _counts(df, cols, exact=False)
    near = [c for c in cols if any(0.9 * cut - 1 <= found[c] <= 1.1 * cut + 1 for cut in cuts)]
    return found | _counts(df, near)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest on ties; absent if all null.

    Unlike the ``mode`` aggregate this holds no value map in one task.
    """
    cols = list(columns)
    if not cols:
        return {}
    best = value_counts(df, cols).groupBy("cid").agg(
        F.min(F.struct((-F.col("n")).alias("n"), *SLOTS)).alias("m"))
    return {cols[r["cid"]]: slot_value(r["m"], df.schema[cols[r["cid"]]].dataType) for r in best.collect()}
