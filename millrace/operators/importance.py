"""Feature importances of fitted pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.hashing import key_hash
from ..functions.storage import stored
from .metrics import r2
from .models import FOURIER

#: Rows of a partition of the ring, on average: a task scores them once per feature.
RING_ROWS = 1 << 16


def _table(df_or_spark, features: Sequence[str], values: Sequence[float]) -> DataFrame:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.createDataFrame(
        [(f, round(float(v), 4)) for f, v in zip(features, values)], "feature string, importance double")


def normalised(values: np.ndarray) -> np.ndarray:
    total = values.sum()
    return values / total if total > 0 else values


def linear_importance(coefficients: np.ndarray) -> np.ndarray:
    """Mean absolute coefficient over classes, scaled to sum 1."""
    return normalised(np.abs(np.atleast_2d(coefficients)).mean(axis=0))


def native_importance(model: Model) -> np.ndarray | None:
    """Tree importances or linear weights of the last stage; None if it has neither."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, OneVsRestModel):
        if hasattr(last.models[0], "featureImportances"):
            return np.mean([m.featureImportances.toArray() for m in last.models], axis=0)
        return None
    if hasattr(last, "featureImportances"):
        return last.featureImportances.toArray()
    if last.getFeaturesCol() == FOURIER:
        return None
    if hasattr(last, "coefficientMatrix"):
        return linear_importance(last.coefficientMatrix.toArray())
    if hasattr(last, "coefficients"):
        return linear_importance(last.coefficients.toArray())
    return None


def permuted_rows(df: DataFrame, x: str, keys: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Add ``repeat`` and ``_next``: each row's ``x`` swapped along one random ring of all rows.

    Rows are ordered by a seeded key hash and each takes the value of its successor, the last one that of the first.
    The order is cut into range partitions; the first value of each, one row a partition, closes the gaps between
    them, so no window is larger than a partition and the ring is one whatever the number of rows. Partitions are counted by
    rows: what follows is work per row, so few bytes must not make few tasks.
    """
    out = None
    parts = max(1, -(-df.count() // RING_ROWS))
    for r in range(repeats):
        order = [F.col("_h"), *[col(k) for k in keys]]
        hashed = df.withColumns({"repeat": F.lit(r), "_h": key_hash(keys, seed=seed + r)})
        ranged = stored(hashed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ring")
        firsts = ranged.groupBy("_part").agg(F.min_by(col(x), F.struct(*order)).alias("_first"))
        along = Window.orderBy("_part")  # one row per partition
        after = firsts.select("_part", F.when(F.lead(F.lit(1)).over(along).isNull(), F.first("_first").over(along))
                              .otherwise(F.lead("_first").over(along)).alias("_after"))
        inside = Window.partitionBy("_part").orderBy(*order)
        last = F.lead(F.lit(1)).over(inside).isNull()
        dealt = ranged.repartitionById(parts, F.col("_part"))
        one = dealt.withColumns({"_last": last, "_lead": F.lead(col(x)).over(inside)}).join(F.broadcast(after), "_part")
        one = one.withColumn("_next", F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_lead")))
        one = one.select(*[col(c) for c in df.columns], "repeat", "_next")
        out = one if out is None else out.unionByName(one)
    return out


def permutation_drops(df: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                      keys: Sequence[str], task: str, label: str = "label", x: str = "x", repeats: int = 5,
                      seed: int = 42) -> DataFrame:
    """``feature, drop``: mean fall of accuracy (r2 for regression) when one feature is permuted.

    ``x`` is an array of feature values; ``predict`` adds ``prediction`` from it. All
    features of a repeat share one shuffle and one scoring pass.
    """
    y, p = col(label).cast("double"), F.col("prediction").cast("double")
    score = r2(y, p) if task == "regression" else F.avg((y == p).cast("double"))
    base = predict(df).agg(score.alias("s")).first()["s"]
    rings = permuted_rows(df, x, keys, repeats, seed)
    swapped = rings.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    swapped = swapped.withColumn(
        x, F.transform(col(x), lambda v, i: F.when(i == F.col("_j"), F.get(F.col("_next"), i)).otherwise(v)))
    scores = predict(swapped).groupBy("_j", "repeat").agg(score.alias("s"))
    names = F.array(*[F.lit(f) for f in features])
    return scores.groupBy("_j").agg((F.lit(base) - F.avg("s")).alias("drop")).select(
        F.element_at(names, F.col("_j") + 1).alias("feature"), "drop")


def permutation_importance(df: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                           keys: Sequence[str], task: str, **options) -> DataFrame:
    """Drops below 0 become 0 and the rest is scaled to sum 1."""
    drops = {r["feature"]: r["drop"] for r in permutation_drops(df, features, predict, keys, task, **options).collect()}
    values = np.array([max(drops.get(f) or 0.0, 0.0) for f in features])
    return _table(df, features, normalised(values))


def importance(model: Model, df: DataFrame, features: Sequence[str], keys: Sequence[str], task: str,
               repeats: int = 5, seed: int = 42) -> DataFrame:
    """``feature, importance`` from the model itself, else by permutation over ``df``,
    which has ``features``, ``label`` and the key columns."""
    native = native_importance(model)
    if native is not None:
        return _table(df, features, native)
    rows = df.select(*[col(k) for k in keys], vector_to_array("features").alias("x"), "label")

    def predict(d: DataFrame) -> DataFrame:
        return model.transform(d.withColumn("features", array_to_vector("x")))

    return permutation_importance(rows, features, predict, keys, task, repeats=repeats, seed=seed)
