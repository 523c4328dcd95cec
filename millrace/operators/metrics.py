"""Scores of a predictions table as relational aggregates, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.running import running_sum

EPSILON = 2.220446049250313e-16  # double machine epsilon, floor of the mape denominator

CLASSIFICATION = ("accuracy", "f1", "roc_auc", "precision", "recall")
REGRESSION = ("rmse", "mae", "r2", "mape")
HIGHER_IS_BETTER = frozenset({"accuracy", "f1", "roc_auc", "precision", "recall", "r2"})


def check_metric(task: str, metric: str | None) -> str:
    """The metric if it fits the task, else accuracy or r2."""
    valid, default = (CLASSIFICATION, "accuracy") if task == "classification" else (REGRESSION, "r2")
    return metric if metric in valid else default


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """``1 - SSE/SST``; null when the target does not vary."""
    return 1 - F.avg((y - p) * (y - p)) / F.nullif(F.var_pop(y), F.lit(0.0))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON)))


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      by: Sequence[str] = ()) -> DataFrame:
    """``rmse, mae, r2, mape`` in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    return df.groupBy(*[col(c) for c in by]).agg(
        rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), r2(y, p).alias("r2"), mape(y, p).alias("mape"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """``label, prediction, n``: at most classes squared rows per group."""
    return df.groupBy(*[col(c) for c in by], col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label, support, precision, recall, f1`` per class from confusion counts; 0 where undefined."""
    group = [col(c) for c in by]
    as_label = counts.select(*group, col("label").alias("label"), F.col("n").alias("support"),
                             F.lit(0).cast("bigint").alias("named"),
                             F.when(col("label") == col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    as_guess = counts.select(*group, col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"),
                             F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hit"))
    sums = as_label.unionByName(as_guess).groupBy(*group, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "named", "hit")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return sums.select(
        *group, "label", "support", "hit",
        ratio(F.col("hit"), F.col("named")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("named")).alias("f1"))


def classification_scores(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` and the support-weighted ``f1, precision, recall``."""
    each = class_scores(confusion(df, label, prediction, by), by)
    total = F.sum("support")
    return each.groupBy(*[col(c) for c in by]).agg(
        (F.sum("hit") / total).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("f1", "precision", "recall")])


def _areas(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """``roc_auc`` and ``n_pos``, the number of positives, per group."""
    by = list(by)
    y = col(label).cast("double")
    per_score = df.groupBy(*[col(c) for c in by], col(score).cast("double").alias("_score")).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y != 1).alias("_neg"))
    below = running_sum(per_score, ["_score"], ["_neg"], by)
    won = F.sum(F.col("_pos") * (F.col("before__neg") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return below.groupBy(*[col(c) for c in by]).agg(
        (won / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"), F.sum("_pos").alias("n_pos"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve of a 0/1 label against a score, ties counted half, as ``roc_auc``.

    Rows are first reduced to counts per distinct score; the number of negatives
    below each score is a running sum over range partitions, not one window.
    """
    return _areas(df, label, score, by).drop("n_pos")


def roc_auc_ovr(df: DataFrame, label: str, scores: str, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest areas weighted by class support. ``scores`` is an array with one score per class;
    a score that is missing, as of a class the model never saw, is 0."""
    by = list(by)
    cells = [F.struct(F.lit(i).alias("_class"), F.coalesce(F.get(col(scores), F.lit(i)), F.lit(0.0)).alias("_s"),
                      (col(label).cast("int") == i).cast("int").alias("_y")) for i in range(n_classes)]
    long = df.select(*[col(c) for c in by], F.inline(F.array(*cells)))
    areas = _areas(long, "_y", "_s", [*by, "_class"]).where("n_pos > 0 AND roc_auc IS NOT NULL")
    return areas.groupBy(*[col(c) for c in by]).agg(
        (F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc"))
