"""Probabilities for margin classifiers: a sigmoid per class, fitted on out-of-fold scores."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stored

#: A fit has converged when a Newton step would lower the loss by no more than this share: about what sums are exact to.
FLAT = 1e-13


def fit_sigmoids(scores: DataFrame, by: str = "class", score: str = "score", hit: str = "hit", rounds: int = 200) -> dict:
    """``{class: (slope, intercept)}`` of ``1 / (1 + exp(-(slope * score + intercept)))`` for a bounded number of classes.

    The targets are drawn in from 0 and 1 as if each side had one more row, which keeps the fit finite when scores separate
    the classes. Newton steps with halving; each is one aggregate over all rows and classes. Rows without a score or hit
    are left out. A fit that doesn't converge raises.
    """
    rows = scores.select(F.col(by).alias("class"), F.col(score).cast("double").alias("f"), F.col(hit).cast("int").alias("hit")).dropna()
    counts = {r["class"]: (r["n"] - r["hits"], r["hits"]) for r in rows.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).collect()}
    targets = {c: (1 / (misses + 2), (hits + 1) / (hits + 2)) for c, (misses, hits) in counts.items()}
    kind = T.StructType([T.StructField("class", rows.schema["class"].dataType), *[
        T.StructField(c, T.DoubleType()) for c in ("slope", "intercept", "low", "high")]])
    z = F.col("slope") * F.col("f") + F.col("intercept")
    p = 1 / (1 + F.exp(-z))
    t = F.when(F.col("hit") > 0, F.col("high")).otherwise(F.col("low"))
    weight = p * (1 - p)
    # log(1 + exp(z)) - t z without overflow
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
    sums = {"loss": loss, "ga": (p - t) * F.col("f"), "gb": p - t, "haa": weight * F.col("f") * F.col("f"), "hab": weight * F.col("f"), "hbb": weight}

    def measure(at: dict) -> dict:
        table = rows.sparkSession.createDataFrame([(c, *at[c], *targets[c]) for c in at], kind)
        found = rows.join(F.broadcast(table), "class").groupBy("class").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
        return {r["class"]: r.asDict() for r in found.collect()}

    place = {c: (0.0, math.log((hits + 1) / (misses + 1))) for c, (misses, hits) in counts.items()}
    known, done, trial, step = measure(place) if place else {}, {}, {}, {}
    for _ in range(rounds):
        for c in [c for c in place if c not in done and c not in trial]:
            m = known[c]
            haa, hbb = m["haa"] + 1e-12 * (1 + m["haa"]), m["hbb"] + 1e-12 * (1 + m["hbb"])
            det = haa * hbb - m["hab"] ** 2
            da, db = -(hbb * m["ga"] - m["hab"] * m["gb"]) / det, -(haa * m["gb"] - m["hab"] * m["ga"]) / det
            step[c] = (da, db, 1.0)
            if -(m["ga"] * da + m["gb"] * db) <= FLAT * max(1.0, m["loss"]):
                done[c] = (place[c][0] + da, place[c][1] + db)
        if len(done) == len(place):
            return done
        trial = {c: tuple(x + step[c][2] * d for x, d in zip(place[c], step[c])) for c in place if c not in done}
        for c, m in measure(trial).items():
            da, db, size = step[c]
            if m["loss"] <= known[c]["loss"] + 1e-4 * size * (known[c]["ga"] * da + known[c]["gb"] * db):
                place[c], known[c] = trial.pop(c), m
            else:
                step[c] = (da, db, size / 2)
    raise RuntimeError(f"the sigmoids of {sorted(set(place) - set(done))} did not converge in {rounds} rounds")


class Sigmoids(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` to ``rawPrediction``: with one sigmoid that of the second of two classes, else one of each class,
    divided by their sum."""

    slopes = Param(Params._dummy(), "slopes", "slope per class", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "intercept per class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, slopes: list[float] | None = None, intercepts: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        slopes, intercepts = self.getOrDefault(self.slopes), self.getOrDefault(self.intercepts)
        raw, first = vector_to_array("rawPrediction"), 1 if len(slopes) == 1 else 0
        each = [1 / (1 + F.exp(-(F.lit(a) * raw[k + first] + F.lit(b)))) for k, (a, b) in enumerate(zip(slopes, intercepts))]
        if first:
            out = F.array(1 - each[0], each[0])
        else:
            total = sum(each[1:], each[0])
            out = F.array(*[F.when(total > 0, e / total).otherwise(1.0 / len(each)) for e in each])
        return dataset.withColumn("probability", array_to_vector(out))


def class_scores(predicted: DataFrame, n_classes: int) -> DataFrame:
    """class, score, hit of every row: its raw score for each class (of two only the second) and whether that is its label."""
    wanted = [1] if n_classes <= 2 else list(range(n_classes))
    raw = vector_to_array("rawPrediction")
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), raw[k].alias("score"), (F.col("label") == k).alias("hit")) for k in wanted]))
    return predicted.select(long.alias("r")).select("r.*")


class CalibratedMargin(Estimator):
    """Fits ``base`` on all rows, and sigmoids on the scores that fits without a fold give to the rows of that fold.

    Folds come from the hash of a row's features and label, so equal rows share a fold and repeated fits agree.
    """

    def __init__(self, base: Estimator, n_classes: int, folds: int = 5):
        super().__init__()
        self.base, self.n_classes, self.folds = base, n_classes, folds

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        rows = dataset.withColumn("_inner", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(self.folds)))
        parts = []
        for k in range(self.folds):
            model = self.base.fit(rows.where(F.col("_inner") != k))
            parts.append(class_scores(model.transform(rows.where(F.col("_inner") == k)), self.n_classes))
        scores = parts[0]
        for part in parts[1:]:
            scores = scores.unionAll(part)
        found = fit_sigmoids(stored(scores, "scores"))
        order = sorted(found)
        final = self.base.fit(dataset)
        return PipelineModel([*final.stages, Sigmoids(slopes=[found[c][0] for c in order], intercepts=[found[c][1] for c in order])])
