"""One-hot vectors without a column per level."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from millrace.operators import features as FE


@pytest.mark.parametrize("broadcast_levels", [FE.BROADCAST_LEVELS, 1])
def test_same_as_columns(spark, broadcast_levels):
    df = spark.range(200).selectExpr("id", "IF(id % 7 = 0, NULL, double(id % 3)) AS x", "IF(id % 11 = 0, NULL, string(id % 5)) AS a",
                                     "id % 2 = 0 AS b", "IF(id < 0, 'never', NULL) AS nothing", "id AS _code_0")
    levels = FE.fit_sparse_levels(df, ["a", "b", "nothing"], broadcast_levels)
    assert levels.width == 5 and levels.offsets == (0, 4, 5)
    wide = FE.one_hot(df.select("id", "x", "a", "b"), ["a", "b"]).orderBy("id").collect()
    found = FE.sparse_features(FE.one_hot_slots(df, ["a", "b", "nothing"], levels), ["x"], levels.width).orderBy("id").collect()
    for w, f in zip(wide, found, strict=True):
        assert f.features.size == 6 and f.features.toArray().tolist() == [w.x or 0.0, *map(float, w[2:])]
        assert 0 not in f.features.values


def test_unknown_levels_have_no_slot(spark):
    levels = FE.fit_sparse_levels(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    found = FE.one_hot_slots(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), ["c"], levels)
    assert sorted(r.slots for r in found.collect()) == [[], [], [], [0]]
    assert FE.one_hot_slots(spark.range(1), []).collect()[0].slots == []


def test_a_million_levels(spark):
    """The plan doesn't grow with the levels, no task holds them all, and a model fits on the vectors."""
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("id", "concat('level', id) AS c", "double(id % 2) AS label")
    levels = FE.fit_sparse_levels(df, ["c"])
    assert levels.width == 999_999 and not levels.codes[0].small
    out = FE.sparse_features(FE.one_hot_slots(df, ["c"], levels), [], levels.width)
    plan = out._jdf.queryExecution().toString()
    assert len(plan) < 20_000 and "Python" not in plan
    assert out.where(F.col("id") < 3).collect()[0].features.size == 999_999
    few = FE.fit_sparse_levels(df.where("id < 300"), ["c"])
    small = FE.sparse_features(FE.one_hot_slots(df.where("id < 300"), ["c"], few), [], few.width)
    assert LinearRegression(maxIter=2, solver="l-bfgs").fit(small).numFeatures == 299
