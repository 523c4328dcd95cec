"""Report tables: overview, model comparison, importances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number_names, text_names
from .metrics import HIGHER_IS_BETTER
from .profile import duplicate_rows, missing, shape


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, copies, number and text column counts."""
    return df.sparkSession.createDataFrame(
        [(
            shape(df).first()["n_rows"], len(df.columns),
            missing(df).agg(F.sum("missing")).first()[0],
            duplicate_rows(df).first()[0],
            len(number_names(df)), len(text_names(df)),
        )],
        "n_rows bigint, n_columns bigint, missing_cells bigint, duplicate_rows bigint, "
        "numeric_columns bigint, text_columns bigint")


def ranked(scores: DataFrame, metric: str) -> DataFrame:
    """Scores best first, names on ties, missing scores last."""
    best_first = F.col("score").desc_nulls_last() if metric in HIGHER_IS_BETTER else F.col("score").asc_nulls_last()
    return scores.orderBy(best_first, "model_name")


def model_comparison(leaderboard: DataFrame, task: str, metric: str) -> DataFrame:
    """``model_name, score, train_score``, with ``r2_score`` for regression."""
    columns = ["model_name", "score", "train_score"] + (["r2_score"] if task == "regression" else [])
    return ranked(leaderboard, metric).select(*columns)


def top_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
