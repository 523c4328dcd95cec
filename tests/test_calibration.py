"""Probabilities of the margin classifier."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.storage import stored
from millrace.operators import calibration, models, selection
from millrace.sources import sinks

SETTINGS = models.Settings(margin_iterations=5, fourier_size=16, margin_folds=3)


def gradient(rows, slope, intercept):
    """Of the loss with drawn-in targets, in numpy."""
    f, hit = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], bool)
    t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-(slope * f + intercept)))
    return ((p - t) * f).sum() / len(f), (p - t).sum() / len(f)


@pytest.mark.parametrize("kind", ["noisy", "separated", "constant", "one side", "far"])
def test_gradient_is_zero(spark, kind):
    rng = np.random.default_rng(3)
    f = rng.normal(size=300) * (1000 if kind == "far" else 1)
    hit = f > 0 if kind == "separated" else f + rng.normal(size=300) * f.std() > f.std() / 2
    if kind == "constant":
        f = np.full(300, 2.0)
    if kind == "one side":
        hit = np.zeros(300, bool)
    rows = list(zip(f.tolist(), hit.tolist()))
    df = spark.createDataFrame([("x", *r) for r in rows] + [("x", None, True), ("x", 1.0, None)], "class string, score double, hit boolean")
    slope, intercept = calibration.fit_sigmoids(df)["x"]
    assert gradient(rows, slope, intercept) == pytest.approx((0, 0), abs=1e-6 * max(1, np.abs(f).max()))
    assert slope > 0 or kind in ("constant", "one side")


def test_no_rows(spark):
    assert calibration.fit_sigmoids(spark.createDataFrame([], "class int, score double, hit boolean")) == {}


@pytest.fixture(scope="module")
def table(spark):
    return stored(spark.range(600).selectExpr(
        "id", "double(id % 37) AS a", "double(id % 11) AS b", "CASE WHEN id % 37 > 18 THEN 'yes' ELSE 'no' END AS two",
        "CASE WHEN id % 37 > 24 THEN 'c' WHEN id % 37 > 12 THEN 'b' ELSE 'a' END AS three"), "test")


@pytest.mark.parametrize("target,n", [("two", 2), ("three", 3)])
def test_probabilities(table, tmp_path, target, n):
    rows, names, n_classes = selection.modelling_table(table.drop(*{"two", "three"} - {target}), target, "classification", ["id"])
    trainer = selection._Trainer(rows, "classification", "roc_auc", len(names), n_classes, 5)
    model = trainer.fit(models.margin_classifier(SETTINGS))
    plain = trainer.fit(models.margin_classifier(dataclasses.replace(SETTINGS, margin_folds=0)))
    again = sinks.load_best(sinks.save_best(model, "SVC", str(tmp_path)))
    out = again.transform(trainer.test).select("id", "label", "prediction", models.vector_to_array("probability").alias("p"))
    found, before = out.collect(), {r.id: r.prediction for r in plain.transform(trainer.test).collect()}
    assert all(len(r.p) == n and sum(r.p) == pytest.approx(1) and min(r.p) >= 0 for r in found)
    assert all(r.prediction == before[r.id] for r in found)
    # on held-out rows: better than the class shares, and close to what happened
    loss = -sum(math.log(max(r.p[int(r.label)], 1e-12)) for r in found) / len(found)
    shares = [sum(r.label == k for r in found) / len(found) for k in range(n)]
    assert loss < -sum(s * math.log(s) for s in shares) - 0.2
    for k in range(n):
        assert sum(r.p[k] for r in found) / len(found) == pytest.approx(shares[k], abs=0.12)
    assert selection._scores(selection._predict(model, trainer.test, "classification"), "classification", "roc_auc", n, [])
