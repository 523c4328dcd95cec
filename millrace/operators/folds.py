"""Held-out rows and cross-validation folds without moving or sorting rows.

A split is a comparison of each row's key (or key hash) with a few threshold
values. The thresholds are exact order statistics per class, so shares are
exact while the rows themselves are only filtered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.hashing import key_hash
from ..functions.order_stats import order_statistics


def held_out(n: int, share: float, stratified: bool) -> int:
    """Rows held out of ``n``: rounded per class (never a whole class), rounded up without classes."""
    if stratified:
        return min(math.floor(n * share + 0.5), n - 1)
    return min(math.ceil(n * share), n - 1) if n else 0


def _with_thresholds(df: DataFrame, column: str, cuts: dict, by: str | None) -> DataFrame:
    """Attach ``_cuts``, the ascending thresholds of the row's class (a bounded, broadcast table)."""
    kind = df.schema[column].dataType
    if by is None:
        values = cuts.get(0, [])
        return df.withColumn("_cuts", F.array(*[F.lit(v).cast(kind) for v in values])
                             if values else F.array().cast(T.ArrayType(kind)))
    schema = T.StructType([T.StructField("_g", df.schema[by].dataType),
                           T.StructField("_cuts", T.ArrayType(kind))])
    table = df.sparkSession.createDataFrame(list(cuts.items()), schema)
    return df.join(F.broadcast(table), col(by) == F.col("_g"), "left").drop("_g")


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, label: str | None = None,
                     seed: int | None = 42) -> DataFrame:
    """Add ``is_test``: the rows with the smallest key hashes, per class if ``label`` is given.

    A class with a single row stays in the training part.
    """
    hashed = df.withColumn("_hash", key_hash(keys, seed=seed))

    def ranks(n: int) -> list[int]:
        k = held_out(n, test_size, label is not None)
        return [k - 1] if k > 0 else []

    found = order_statistics(hashed, ["_hash"], ranks, label)
    cuts = {g: vals for (g, _), (_, vals) in found.items()}
    out = _with_thresholds(hashed, "_hash", cuts, label)
    is_test = F.coalesce(F.col("_hash") <= F.get(F.col("_cuts"), F.lit(0)), F.lit(False))
    return out.withColumn("is_test", is_test).drop("_hash", "_cuts")


def ordered_folds(df: DataFrame, order: str, k: int = 5, label: str | None = None, name: str = "fold",
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``name`` 0..k-1: equal contiguous blocks along a unique number key, per class if
    ``label`` is given; the first blocks take the remainder. ``fit_on`` sets other rows to
    take the block borders from."""
    def ranks(n: int) -> list[int]:
        size, extra = divmod(n, k)
        starts = [i * size + min(i, extra) for i in range(1, k)]
        return [s for s in starts if s < n]

    found = order_statistics(df if fit_on is None else fit_on, [order], ranks, label)
    cuts = {g: vals for (g, _), (_, vals) in found.items()}
    out = _with_thresholds(df, order, cuts, label)
    passed = F.size(F.filter(F.col("_cuts"), lambda c: c <= col(order)))
    return out.withColumn(name, F.coalesce(passed, F.lit(0)).cast("int")).drop("_cuts")


def hash_fold(keys: Sequence[str], k: int = 5, seed: int | None = None) -> Column:
    """Fold 0..k-1 from the key hash alone: one projection, no statistics."""
    return (key_hash(keys, digits=8, seed=seed) % k).cast("int")


def stratified_folds(df: DataFrame, keys: Sequence[str], label: str, k: int = 5, seed: int | None = None, name: str = "fold",
                     fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``name`` 0..k-1: each class in equal parts, in the order of the key hash. ``fit_on`` as in ``ordered_folds``."""
    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_order", key_hash(keys, seed=seed))

    return ordered_folds(hashed(df), "_order", k, label, name, None if fit_on is None else hashed(fit_on)).drop("_order")
