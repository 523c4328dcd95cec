"""Candidate models as Spark ML pipelines over a ``features`` vector and a ``label``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .calibration import CalibratedMargin
from .least_norm import MinimumNormRegression

SCALED = "scaled"
FOURIER = "fourier"
NORMAL_SOLVER_FEATURES = 4096  # limit of Spark's normal-equation solver


@dataclass(frozen=True)
class Settings:
    """Sizes of the candidates. The defaults are the library's; lower them for a quick look."""

    trees: int = 100
    rounds: int = 100
    forest_depth: int = 30
    boost_depth: int = 3
    step_size: float = 0.1
    linear_iterations: int = 1000
    margin_iterations: int = 100
    #: folds of out-of-fold scores from which the margin classifier learns probabilities; 0: raw scores only
    margin_folds: int = 0
    #: least squares of minimum norm, for features that depend on one another; else Spark's solver, with the same predictions
    minimum_norm: bool = False
    alpha: float = 1.0
    fourier_size: int = 128
    seed: int = 42


@dataclass(frozen=True)
class TrainingFacts:
    """What a regularisation strength depends on, for one training set."""

    n_rows: int
    n_features: int
    n_classes: int = 0
    label_std: float = 0.0  # population deviation


# Scaling ------------------------------------------------------------------------

def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    row = df.agg(*[
        f(col(c).cast("double")).alias(f"{n}{i}")
        for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# Random Fourier features -----------------------------------------------------------

class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner products approximate an RBF kernel with gamma 1/d.

    Exact kernel machines compare all pairs of rows; on these features a linear
    model gives an approximation whose cost grows with the rows. Scores differ
    from those of an exact kernel solver. The draw depends on the seed alone.
    """

    size = Param(Params._dummy(), "size", "number of cosine features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "length of the input vector", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draw", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = SCALED, outputCol: str = FOURIER, size: int = 128,
                 inputs: int = 1, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol=SCALED, outputCol=FOURIER, size=128, inputs=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, size = self.getOrDefault(self.inputs), self.getOrDefault(self.size)
        draw = np.random.default_rng(self.getOrDefault(self.seed))
        weights = draw.normal(0.0, np.sqrt(2.0 / d), (d, size))
        shift = draw.uniform(0.0, 2.0 * np.pi, size)

        @F.arrow_udf("array<double>")
        def cosines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
                z = np.sqrt(2.0 / size) * np.cos(x @ weights + shift)
                yield pa.ListArray.from_arrays(np.arange(0, z.size + 1, size, dtype=np.int32), z.ravel())

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


def linear_terms(model, features: list[str]) -> dict[str, float]:
    """Intercept and coefficients of a scaled linear pipeline, in the units of the features."""
    scaler, linear = model.stages
    weights = linear.coefficients.toArray() / np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
    terms = {"intercept": float(linear.intercept - weights @ scaler.mean.toArray())}
    return terms | {f: float(w) for f, w in zip(features, weights)}


# Candidates --------------------------------------------------------------------------

Builder = Callable[[TrainingFacts], Estimator]


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol=SCALED, withMean=True, withStd=True)


def _fourier(s: Settings, facts: TrainingFacts) -> FourierFeatures:
    return FourierFeatures(size=s.fourier_size, inputs=facts.n_features, seed=s.seed)


def logistic_regression(s: Settings = Settings()) -> Builder:
    """L2 with C = 1: the summed loss of the usual form is Spark's mean loss, hence 1/n."""
    return lambda facts: Pipeline(stages=[_scaler(), LogisticRegression(
        featuresCol=SCALED, regParam=1.0 / facts.n_rows, elasticNetParam=0.0, standardization=False,
        maxIter=s.linear_iterations, family="auto")])


def forest_classifier(s: Settings = Settings()) -> Builder:
    return lambda facts: Pipeline(stages=[RandomForestClassifier(
        numTrees=s.trees, maxDepth=s.forest_depth, featureSubsetStrategy="sqrt", seed=s.seed)])


def boosted_classifier(s: Settings = Settings()) -> Builder:
    """Boosting of two classes; more classes are boosted one against the rest."""
    def build(facts: TrainingFacts) -> Estimator:
        boost = GBTClassifier(maxIter=s.rounds, maxDepth=s.boost_depth, stepSize=s.step_size, seed=s.seed)
        return Pipeline(stages=[boost if facts.n_classes <= 2 else OneVsRest(classifier=boost)])
    return build


def margin_classifier(s: Settings = Settings()) -> Builder:
    """Support vector classifier with an approximated RBF kernel, C = 1; with ``margin_folds`` it gives probabilities."""
    def build(facts: TrainingFacts) -> Estimator:
        svc = LinearSVC(featuresCol=FOURIER, regParam=1.0 / facts.n_rows, maxIter=s.margin_iterations,
                        standardization=False)
        last = svc if facts.n_classes <= 2 else OneVsRest(classifier=svc, featuresCol=FOURIER)
        margins = Pipeline(stages=[_scaler(), _fourier(s, facts), last])
        return CalibratedMargin(margins, facts.n_classes, s.margin_folds) if s.margin_folds else margins
    return build


def _solver(facts: TrainingFacts) -> str:
    return "normal" if facts.n_features <= NORMAL_SOLVER_FEATURES else "l-bfgs"


def linear_regression(s: Settings = Settings()) -> Builder:
    return lambda facts: Pipeline(stages=[_scaler(), MinimumNormRegression(featuresCol=SCALED) if s.minimum_norm else LinearRegression(
        featuresCol=SCALED, solver=_solver(facts))])


def ridge(s: Settings = Settings()) -> Builder:
    """Penalty ``alpha`` on population-scaled features.

    Spark's solver works on the label divided by its deviation and on mean loss,
    and the scaler uses the sample deviation; the strength undoes all three.
    """
    def build(facts: TrainingFacts) -> Estimator:
        n = facts.n_rows
        strength = s.alpha * facts.label_std / n * (n - 1) / n if n > 1 else 0.0
        return Pipeline(stages=[_scaler(), LinearRegression(
            featuresCol=SCALED, solver=_solver(facts), regParam=strength, elasticNetParam=0.0,
            standardization=False)])
    return build


def forest_regressor(s: Settings = Settings()) -> Builder:
    return lambda facts: Pipeline(stages=[RandomForestRegressor(
        numTrees=s.trees, maxDepth=s.forest_depth, featureSubsetStrategy="all", seed=s.seed)])


def boosted_regressor(s: Settings = Settings()) -> Builder:
    return lambda facts: Pipeline(stages=[GBTRegressor(
        maxIter=s.rounds, maxDepth=s.boost_depth, stepSize=s.step_size, seed=s.seed)])


def margin_regressor(s: Settings = Settings()) -> Builder:
    """Support vector regression with an approximated RBF kernel and a Huber loss."""
    return lambda facts: Pipeline(stages=[_scaler(), _fourier(s, facts), LinearRegression(
        featuresCol=FOURIER, loss="huber", regParam=1.0 / facts.n_rows, maxIter=s.margin_iterations,
        standardization=False)])


def candidates(task: str, settings: Settings = Settings()) -> dict[str, Builder]:
    """The models compared for a task, by the name they carry in the leaderboard."""
    if task == "classification":
        return {
            "LogisticRegression": logistic_regression(settings),
            "RandomForestClassifier": forest_classifier(settings),
            "GradientBoostingClassifier": boosted_classifier(settings),
            "SVC": margin_classifier(settings),
        }
    return {
        "LinearRegression": linear_regression(settings),
        "Ridge": ridge(settings),
        "RandomForestRegressor": forest_regressor(settings),
        "GradientBoostingRegressor": boosted_regressor(settings),
        "SVR": margin_regressor(settings),
    }


def class_score_array(predicted: DataFrame) -> Column:
    """One score per class: probabilities where the model has them, else raw scores."""
    source = "probability" if "probability" in predicted.columns else "rawPrediction"
    return vector_to_array(source)
