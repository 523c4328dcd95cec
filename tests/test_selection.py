"""Training, ranking and importances on small tables."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.storage import stored
from millrace.operators import importance as I
from millrace.operators import models, selection
from millrace.operators.features import assemble
from millrace.sources import sinks

TINY = models.Settings(trees=3, rounds=2, forest_depth=3, margin_iterations=5, linear_iterations=20, fourier_size=16)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(400).selectExpr(
        "id", "double(id % 37) AS a", "double(id % 11) AS b", "id % 2 = 0 AS flag",
        "CASE WHEN id % 37 > 18 THEN 'yes' ELSE 'no' END AS kind",
        "3D * (id % 37) - 2D * (id % 11) + 5D AS amount")
    return stored(df, "test")


def broken(facts):
    raise RuntimeError("no such model")


def test_two_classes_all_candidates(table):
    got = selection.train_and_evaluate(table.drop("amount"), "kind", "classification", "roc_auc", keys=["id"],
                                       settings=TINY)
    board = got.leaderboard.collect()
    assert {r["model_name"] for r in board} == set(models.candidates("classification"))
    scores = [r["score"] for r in board]
    assert scores == sorted(scores, reverse=True) and 0.95 < scores[0] <= 1
    assert all(0 <= r[c] <= 1 for r in board for c in ("score", "train_score", "holdout_score"))
    assert json.loads(board[0]["params"])
    shares = {r["feature"]: r["importance"] for r in got.importance.collect()}
    assert set(shares) == {"a", "b", "flag"} and max(shares, key=shares.get) == "a"
    assert sum(shares.values()) == pytest.approx(1, abs=1e-3)


def test_linear_finds_the_rule_and_failures_are_left_out(table, tmp_path):
    got = selection.train_and_evaluate(
        table.drop("kind"), "amount", "regression", "rmse", keys=["id"], order="id",
        builders={"LinearRegression": models.linear_regression(), "Broken": broken})
    row = got.leaderboard.collect()
    assert [r["model_name"] for r in row] == ["LinearRegression"]
    assert row[0]["score"] == pytest.approx(0, abs=1e-6) and row[0]["r2_score"] == pytest.approx(1)
    terms = models.linear_terms(got.best, ["a", "b", "flag"])
    assert (terms["intercept"], terms["a"], terms["b"]) == pytest.approx((5, 3, -2))
    assert sinks.load_best(sinks.save_best(got.best, got.best_name, str(tmp_path))).stages


def test_nothing_left(table):
    with pytest.raises(RuntimeError, match="no candidate"):
        selection.train_and_evaluate(table.drop("kind"), "amount", "regression", keys=["id"], builders={"Broken": broken})


def test_few_rows_score_in_sample(table):
    few = table.where("id < 80").drop("kind")
    got = selection.train_and_evaluate(few, "amount", "regression", "mae", keys=["id"],
                                       builders={"Ridge": models.ridge()}, min_rows_for_folds=100)
    assert got.leaderboard.first()["train_score"] is not None


def test_rare_class_keeps_its_candidates(spark):
    """A class with one row: some fits never see it, yet every candidate is scored."""
    df = spark.range(300).selectExpr("id", "double(id % 17) AS a", "double(id % 5) AS b",
                                     "CASE WHEN id = 77 THEN 'z' WHEN id % 17 > 8 THEN 'y' ELSE 'x' END AS kind")
    got = selection.train_and_evaluate(df, "kind", "classification", "roc_auc", keys=["id"], cv=3,
                                       builders={"LogisticRegression": models.candidates("classification")["LogisticRegression"]})
    assert got.leaderboard.count() == 1 and got.leaderboard.first()["score"] > 0.9


def test_three_classes_by_support(table):
    df = table.withColumn("kind", F.when(F.col("a") < 9, "low").when(F.col("a") < 25, "mid").otherwise("high"))
    got = selection.train_and_evaluate(
        df.drop("amount"), "kind", "classification", "f1", keys=["id"], order="id",
        builders={"GradientBoostingClassifier": models.boosted_classifier(TINY)})
    assert got.leaderboard.first()["score"] > 0.9
    shares = [r["importance"] for r in got.importance.collect()]
    assert sum(shares) == pytest.approx(1, abs=1e-3)


def test_folds_cover_training_rows_once(table):
    made, names, _ = selection.modelling_table(table.drop("amount"), "kind", "classification", ["id"], order="id")
    counts = made.groupBy("is_test", "kind" if "kind" in made.columns else "label").count().collect()
    assert names == ["a", "b", "flag"] and sum(r["count"] for r in counts) == 400
    train = made.where("NOT is_test")
    sizes = [r["count"] for r in train.groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 5
    assert train.select("train_fold").distinct().count() == 3


def test_fold_fits_skip_files(table):
    made, _, _ = selection.modelling_table(table.drop("kind"), "amount", "regression", ["id"])
    text = made.where("NOT is_test AND fold != 2")._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):].split("]")[0]
    assert "is_test" in filters and "fold" in filters


def test_same_seed_same_scores(table):
    def run():
        got = selection.train_and_evaluate(
            table.drop("kind"), "amount", "regression", "rmse", keys=["id"],
            builders={"RandomForestRegressor": models.forest_regressor(TINY)}, reproducible=True)
        return got.leaderboard.drop("params").collect(), got.importance.collect()
    assert run() == run()


def test_ridge_equals_closed_form(spark, table):
    rows = np.array(table.select("a", "b", "amount").collect(), dtype=float)
    x, y, alpha = rows[:, :2], rows[:, 2] + np.sin(rows[:, 0]), 25.0
    scaled = (x - x.mean(0)) / x.std(0)
    weights = np.linalg.solve(scaled.T @ scaled + alpha * np.eye(2), scaled.T @ (y - y.mean())) / x.std(0)
    df = assemble(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, label double"), ["a", "b"])
    facts = models.TrainingFacts(len(y), 2, 0, float(y.std()))
    terms = models.linear_terms(models.ridge(models.Settings(alpha=alpha))(facts).fit(df), ["a", "b"])
    assert (terms["a"], terms["b"]) == pytest.approx(tuple(weights), rel=1e-6)


def test_fourier_inner_products_approximate_the_kernel(spark):
    draw = np.random.default_rng(3).normal(size=(30, 3))
    df = assemble(spark.createDataFrame([tuple(map(float, r)) for r in draw], "a double, b double, c double"), ["a", "b", "c"], "scaled")
    out = np.array([r["fourier"].toArray() for r in models.FourierFeatures(size=4000, inputs=3).transform(df).collect()])
    exact = np.exp(-((draw[:, None] - draw[None]) ** 2).sum(-1) / 3)
    assert np.abs(out @ out.T - exact).max() < 0.1


def test_linear_importance_averages_classes():
    assert list(I.linear_importance(np.array([[1.0, -3.0], [3.0, 1.0]]))) == [0.5, 0.5]
    assert list(I.linear_importance(np.array([0.0, 0.0]))) == [0.0, 0.0]
