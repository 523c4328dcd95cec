"""Least squares of minimum norm, for features that may depend on one another."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are reduced at a time, and triangles that one task of the next level reduces.
CHUNK, FAN_IN = 4096, 32


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def triangle(rows: DataFrame, columns: int) -> np.ndarray:
    """The triangular factor of a table with one array column ``row`` of length ``columns``, by a tree of reductions.

    A task holds one chunk of rows and one triangle; each level brings ``FAN_IN`` triangles together until one is left.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, columns))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(-1, columns)
            for at in range(0, len(values), CHUNK):
                held = _triangle(np.vstack([held, values[at:at + CHUNK]]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], names=["row"])

    parts = rows.mapInArrow(reduce, "row array<double>")
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = math.ceil(tasks / FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(reduce, "row array<double>")  # only triangles are moved
    found = parts.collect()  # at most one row per column from the last task
    return np.array([r["row"] for r in found]).reshape(-1, columns)


class LinearTerms(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``: the inner product of a vector with ``weights``, plus ``constant``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight per place", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "what is added", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", weights: list[float] | None = None, constant: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol="features", constant=0.0)
        self._set(**self._input_kwargs)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.weights))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.constant)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.getOrDefault(self.weights)]).cast("array<double>")
        terms = F.zip_with(vector_to_array(self.getOrDefault(self.featuresCol)), weights, lambda x, w: x * w)
        return dataset.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda a, t: a + t))


class MinimumNormRegression(Estimator):
    """Of all coefficients with the least squared error, those with the smallest sum of squares.

    Rows are reduced to triangles; the root's singular values below ``cutoff`` of the largest (by default the precision of
    doubles times the number of features and the root of the number of rows) count as zero.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", cutoff: float | None = None):
        super().__init__()
        self.features, self.label, self.cutoff = featuresCol, labelCol, cutoff

    def _fit(self, dataset: DataFrame) -> LinearTerms:
        values = F.concat(F.array(F.lit(1.0)), vector_to_array(self.features), F.array(F.col(self.label).cast("double")))
        rows = dataset.select(values.alias("row")).where(F.col(self.label).isNotNull())
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        size = len(first["row"])
        found = triangle(rows, size)
        found = np.vstack([found, np.zeros((max(0, size - len(found)), size))])[:size]
        # the first row carries the sums: below it, features and label are centred
        u, s, v = np.linalg.svd(found[1:, 1:-1], full_matrices=False)
        largest = s[0] if len(s) else 0.0
        root = abs(found[0, 0])  # of the number of rows, as the first column holds ones
        kept = s > (np.finfo(float).eps * size * root if self.cutoff is None else self.cutoff) * largest
        weights = v[kept].T @ ((u[:, kept].T @ found[1:, -1]) / s[kept])
        constant = (found[0, -1] - found[0, 1:-1] @ weights) / found[0, 0]
        return LinearTerms(featuresCol=self.features, weights=weights.tolist(), constant=float(constant))
