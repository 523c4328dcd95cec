"""Training, cross-validating and ranking the candidates."""

from __future__ import annotations

import functools
import json
import logging
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.storage import stored
from .features import apply_codes, assemble, feature_matrix, feature_names, fit_codes
from .folds import hash_fold, ordered_folds, stratified_folds, train_test_split
from .importance import importance
from .metrics import (
    HIGHER_IS_BETTER, check_metric, classification_scores, regression_scores, roc_auc, roc_auc_ovr,
)
from .models import Builder, Settings, TrainingFacts, candidates, class_score_array

log = logging.getLogger(__name__)

TRAIN_FOLDS = 3
LEADERBOARD = ("model_name string, score double, train_score double, r2_score double, r2_train_score double, "
               "holdout_score double, params string")


@dataclass
class Selection:
    """Ranked candidates, the winner refitted on all training rows, and its importances."""

    leaderboard: DataFrame
    best_name: str | None
    best: Model | None
    importance: DataFrame | None
    metric: str


def label_codes(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """Add ``label``: the sorted code of the target's value as a double, and the class count."""
    codes = fit_codes(df, [target])
    n = codes[0].table.count()
    # all classes, so that a model fitted without a rare one still scores as many
    kind = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n}}
    return apply_codes(df, codes, {target: "label"}).withColumn("label", F.col("label").cast("double").alias("label", metadata=kind)), n


def modelling_table(df: DataFrame, target: str, task: str, keys: Sequence[str], cv: int = 5, test_size: float = 0.2,
                    seed: int = 42, order: str | None = None) -> tuple[DataFrame, list[str], int]:
    """Key columns, ``features``, ``label``, ``is_test`` and the two fold columns, stored once.

    With ``order`` (a unique number column) folds are contiguous blocks in that
    order, per class when classifying; otherwise they come from the key hash, again
    in equal parts per class when classifying.
    """
    classify = task == "classification"
    rows = df.where(col(target).isNotNull())
    names = feature_names(rows, target, keys)
    extra = list(dict.fromkeys([*keys, *([order] if order else [])]))
    matrix = feature_matrix(rows, target, extra)
    n_classes = 0
    if classify:
        matrix, n_classes = label_codes(matrix, target)
    else:
        matrix = matrix.withColumn("label", col(target).cast("double"))
    by = "label" if classify else None
    table = train_test_split(assemble(matrix, names), keys, test_size, by, seed).select(
        *[col(c) for c in extra], "features", "label", "is_test")
    for name, k in (("fold", cv), ("train_fold", TRAIN_FOLDS)):
        if order:
            table = ordered_folds(table, order, k, by, name, fit_on=table.where(~F.col("is_test")))
        elif classify:
            table = stratified_folds(table, keys, "label", k, seed, name, fit_on=table.where(~F.col("is_test")))
        else:
            table = table.withColumn(name, hash_fold(keys, k, seed))
    return stored(table, "modelling", ["is_test", "fold"]), names, n_classes


def _scores(predicted: DataFrame, task: str, metric: str, n_classes: int, by: Sequence[str]) -> dict[int, dict]:
    """Metric values per group from one predictions table."""
    if task == "regression":
        table = regression_scores(predicted, by=by)
    elif metric == "roc_auc":
        table = (roc_auc_ovr(predicted, "label", "scores", n_classes, by) if n_classes > 2 else
                 roc_auc(predicted.withColumn("_score", F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0))), "label", "_score", by))
    else:
        table = classification_scores(predicted, by=by)
    return {tuple(r[c] for c in by): r.asDict() for r in table.collect()}


def _mean(found: dict, metric: str) -> float | None:
    values = [row[metric] for row in found.values() if row[metric] is not None]
    return sum(values) / len(values) if values else None


def _predict(model: Model, rows: DataFrame, task: str, extra: Sequence[str] = ()) -> DataFrame:
    out = model.transform(rows)
    columns = [F.col("label"), F.col("prediction"), *[F.col(c) for c in extra]]
    if task == "classification":
        columns.append(class_score_array(out).alias("scores"))
    return out.select(*columns)


class _Trainer:
    def __init__(self, table: DataFrame, task: str, metric: str, n_features: int, n_classes: int, cv: int,
                 layout: Sequence[str] = (), min_rows: int = 0):
        self.layout = list(layout)
        self.min_rows = min_rows
        self.train = table.where(~F.col("is_test"))
        self.test = table.where("is_test")
        self.task, self.metric, self.cv = task, metric, cv
        self.n_features, self.n_classes = n_features, n_classes
        label = F.col("label")
        sums = [F.count(F.lit(1)).alias("n"), F.avg(label).alias("m"), F.var_pop(label).alias("v")]
        # at most cv * 3 rows: enough for the facts of every training subset
        self.cells = self.train.groupBy("fold", "train_fold").agg(*sums).collect()
        self.n_rows = sum(r["n"] for r in self.cells)

    def facts(self, fold: str | None = None, out: int | None = None) -> TrainingFacts:
        cells = [r for r in self.cells if fold is None or r[fold] != out]
        n = sum(r["n"] for r in cells)
        mean = sum(r["n"] * r["m"] for r in cells) / n if n else 0.0
        spread = sum(r["n"] * (r["v"] + (r["m"] - mean) ** 2) for r in cells)
        return TrainingFacts(n, self.n_features, self.n_classes, math.sqrt(spread / n) if n else 0.0)

    def fit(self, build: Builder, fold: str | None = None, out: int | None = None) -> Model:
        """One fit, on all training rows or without one fold; laid out by key if asked."""
        rows = self.train if fold is None else self.train.where(F.col(fold) != out)
        if self.layout:
            parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            keys = [col(c) for c in self.layout]
            rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys)
        return build(self.facts(fold, out)).fit(rows)

    def scores(self, predicted: DataFrame, by: Sequence[str] = ()) -> dict:
        return _scores(predicted, self.task, self.metric, self.n_classes, by)

    def fold_scores(self, models: Sequence[Model], fold: str) -> dict:
        """Scores per fold, all folds in one aggregate."""
        parts = [_predict(m, self.train.where(F.col(fold) == i), self.task, [fold]) for i, m in enumerate(models)]
        return self.scores(functools.reduce(DataFrame.unionByName, parts), [fold])

    def fits(self) -> list[tuple[str | None, int | None]]:
        """The fits one candidate needs."""
        again = [("train_fold", i) for i in range(TRAIN_FOLDS)] if self.n_rows >= self.min_rows else []
        return [(None, None), *[("fold", i) for i in range(self.cv)], *again]

    def evaluate(self, name: str, models: dict[tuple, Model]) -> dict:
        final = models[(None, None)]
        folds = self.fold_scores([models[("fold", i)] for i in range(self.cv)], "fold")
        if self.n_rows >= self.min_rows:
            again = self.fold_scores([models[("train_fold", i)] for i in range(TRAIN_FOLDS)], "train_fold")
        else:
            again = self.scores(_predict(final, self.train, self.task))
        held = self.scores(_predict(final, self.test, self.task))
        row = {
            "model_name": name, "score": _mean(folds, self.metric), "train_score": _mean(again, self.metric),
            "r2_score": _mean(folds, "r2") if self.task == "regression" else None,
            "r2_train_score": _mean(again, "r2") if self.task == "regression" else None,
            "holdout_score": _mean(held, self.metric), "params": params_json(final),
        }
        return {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items()}


def params_json(model: Model) -> str:
    """Parameters of the last stage as JSON text; of its inner model when one against the rest."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    last = last.models[0] if isinstance(last, OneVsRestModel) else last
    return json.dumps({p.name: v for p, v in last.extractParamMap().items()}, default=str, sort_keys=True)


def params_table(model: Model, df: DataFrame) -> DataFrame:
    """``name, value`` of the last stage's parameters."""
    pairs = json.loads(params_json(model)).items()
    return df.sparkSession.createDataFrame([(k, str(v)) for k, v in pairs], "name string, value string")


def evaluate_candidates(table: DataFrame, task: str, metric: str, n_features: int, n_classes: int, cv: int,
                        builders: dict[str, Builder], parallelism: int = 4,
                        layout: Sequence[str] = (), min_rows: int = 0) -> dict[str, tuple[dict, Model]]:
    """Score and model per candidate; one that fails is logged and left out. If all fail, the last failure is raised.

    Like CrossValidator, independent fits are submitted from a few driver threads.
    """
    trainer = _Trainer(table, task, metric, n_features, n_classes, cv, layout, min_rows)
    failure: Exception | None = None
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        def submit(run, *args):
            return pool.submit(inheritable_thread_target(table.sparkSession)(run), *args)

        fitting = {name: {key: submit(trainer.fit, build, *key) for key in trainer.fits()}
                   for name, build in builders.items()}
        results: dict[str, tuple[dict, Model]] = {}
        scoring = {}
        for name, jobs in fitting.items():
            try:
                models = {key: job.result() for key, job in jobs.items()}
                scoring[name] = (submit(trainer.evaluate, name, models), models[(None, None)])
            except Exception as error:  # one model must not end the comparison
                log.warning("%s failed: %s", name, error)
                failure = error
        for name, (job, final) in scoring.items():
            try:
                results[name] = (job.result(), final)
            except Exception as error:
                log.warning("%s could not be scored: %s", name, error)
                failure = error
    if failure is not None and not results:
        raise RuntimeError("no candidate could be fitted and scored") from failure
    return results


def train_and_evaluate(
    df: DataFrame, target: str, task: str, metric: str | None = None, *, keys: Sequence[str], cv: int = 5,
    test_size: float = 0.2, seed: int = 42, order: str | None = None, settings: Settings = Settings(),
    builders: dict[str, Builder] | None = None, parallelism: int = 4, reproducible: bool = False,
    min_rows_for_folds: int = 0,
) -> Selection:
    """Compare the candidates on the training part and rank them.

    ``keys`` name the columns that identify a row; they steer the split and folds
    and are not features. ``score`` is the mean over ``cv`` folds, ``train_score``
    over three folds (in-sample below ``min_rows_for_folds`` rows), ``holdout_score`` comes from the
    rows kept out of all fits.

    Spark ML samples trees along the row layout, which may differ from run to run.
    ``reproducible`` lays rows out by key before each fit, at one shuffle a fit, so
    that equal seeds give equal models.
    """
    metric = check_metric(task, metric)
    table, names, n_classes = modelling_table(df, target, task, keys, cv, test_size, seed, order)
    results = evaluate_candidates(table, task, metric, len(names), n_classes, cv,
                                  builders or candidates(task, settings), parallelism,
                                  keys if reproducible else (), min_rows_for_folds)
    sign = -1 if metric in HIGHER_IS_BETTER else 1

    def place(row: dict) -> tuple:
        score = row["score"]
        lost = score is None or math.isnan(score)
        return (lost, 0.0 if lost else sign * score, row["model_name"])

    rows = sorted((row for row, _ in results.values()), key=place)
    board = df.sparkSession.createDataFrame(
        [tuple(r[c.split()[0]] for c in LEADERBOARD.split(", ")) for r in rows], LEADERBOARD)
    if not rows:
        return Selection(board, None, None, None, metric)
    best_name = rows[0]["model_name"]
    best = results[best_name][1]
    train = table.where(~F.col("is_test"))
    return Selection(board, best_name, best, importance(best, train, names, keys, task, seed=seed), metric)
