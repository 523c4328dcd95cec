"""Least squares of minimum norm against the pseudo-inverse."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from millrace.operators import least_norm, models
from millrace.operators.features import assemble
from millrace.sources import sinks


@pytest.mark.parametrize("kind", ["full", "sum", "copy", "constant", "few rows"])
def test_pseudo_inverse(spark, monkeypatch, kind):
    monkeypatch.setattr(least_norm, "CHUNK", 17)
    monkeypatch.setattr(least_norm, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2 if kind == "few rows" else 200, 3)) * [1, 5, 0.1] + [3, 0, 100]
    x = {"full": x, "few rows": x, "sum": np.c_[x, x[:, 0] + x[:, 1]], "copy": np.c_[x, x[:, 1]], "constant": np.c_[x, np.full(len(x), 7.0)]}[kind]
    y = x @ rng.normal(size=x.shape[1]) + rng.normal(size=len(x)) + 11
    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y)], ["features", "label"])
    model = least_norm.MinimumNormRegression().fit(df.repartition(7))
    centred = x - x.mean(0)
    want = np.linalg.pinv(centred, rcond=1e-12) @ (y - y.mean())
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6, abs=1e-8)
    found = [r.prediction for r in model.transform(df).collect()]
    assert found == pytest.approx(centred @ want + y.mean())


def test_pipeline_is_saved_and_loaded(spark, tmp_path):
    df = spark.range(100).selectExpr("double(id) AS a", "double(id % 7) AS b", "double(3 * id - (id % 7) + 2) AS label")
    table = assemble(df, ["a", "b"])
    model = models.linear_regression(models.Settings(minimum_norm=True))(models.TrainingFacts(100, 2)).fit(table)
    terms = models.linear_terms(model, ["a", "b"])
    assert (terms["intercept"], terms["a"], terms["b"]) == pytest.approx((2, 3, -1))
    again = sinks.load_best(sinks.save_best(model, "LinearRegression", str(tmp_path)))
    assert all(r.prediction == pytest.approx(r.label) for r in again.transform(table).collect())


def test_no_rows(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)], ["features", "label"])
    with pytest.raises(ValueError):
        least_norm.MinimumNormRegression().fit(df.where("label > 1"))
