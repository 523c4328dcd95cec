"""Plan rules and prepared tables."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from millrace.operators.profile import Profile
from millrace.plans import prepare, steps

BASE = Profile(
    n_rows=1000, dtypes={"n": "double", "m": "int", "s": "string", "w": "string", "y": "double"},
    numeric=["n", "m", "y"], text=["s", "w"], missing={"n": 3, "m": 0, "s": 0, "w": 0, "y": 1},
    n_unique={"n": 100, "m": 1, "s": 3, "w": 400, "y": 500}, skewed=["n", "y"], duplicates=2)


def test_default_plan():
    plan = steps.default_plan(BASE, "y")
    assert plan["cleaning_steps"] == [
        {"step": "drop_constants", "columns": ["m"]},
        {"step": "handle_missing", "columns": ["n"], "method": "median"},
        {"step": "drop_duplicates", "columns": []}]
    assert plan["feature_steps"] == [
        {"step": "encode_categorical", "columns": ["w"], "method": "label"},
        {"step": "log_transform", "columns": ["n"]}]
    big = dataclasses.replace(BASE, n_rows=10**12)
    assert steps.default_plan(big, "y") == plan
    assert [s["step"] for s in steps.default_plan(big, "y", steps.Limits(log_rows=50_000))["feature_steps"]] == ["encode_categorical"]


def test_cleaning_check():
    got = steps.check_cleaning([
        "noise", {"step": "invented"}, {"step": "drop_constants", "columns": []},
        {"step": "remove_outliers", "columns": ["n", "n", "y", "gone"], "method": "median"},
        {"step": "remove_outliers", "columns": ["n"]},
        {"step": "fix_dtypes", "columns": ["s"], "target_dtype": "colour"}], BASE, "y")
    assert got == [
        {"step": "drop_duplicates", "columns": []},
        {"step": "remove_outliers", "columns": ["n"], "method": "iqr"},
        {"step": "fix_dtypes", "columns": ["s"], "target_dtype": "numeric"},
        {"step": "handle_missing", "columns": ["n"], "method": "median"}]
    assert steps.check_plan(None, BASE, "y")["feature_steps"] == []


def test_feature_check():
    got = steps.check_features([
        {"step": "encode_categorical", "method": "onehot"},
        {"step": "encode_categorical", "columns": ["s"], "method": "onehot"},
        {"step": "log_transform"}, {"step": "log_transform", "columns": ["s"]},
        {"step": "polynomial_features", "columns": ["n", "s"], "degree": 7},
        {"step": "interaction_features", "columns": ["n", "m"]},
        {"step": "interaction_features", "columns": ["m", "n"]}], BASE, "y")
    assert got == [
        {"step": "encode_categorical", "columns": ["s", "w"], "method": "label"},
        {"step": "encode_categorical", "columns": ["s"], "method": "onehot"},
        {"step": "log_transform", "columns": ["n"]},
        {"step": "polynomial_features", "columns": ["n"], "degree": 2},
        {"step": "interaction_features", "columns": ["n", "m"]},
        {"step": "interaction_features", "columns": ["m", "n"]}]


def test_heavy_steps_are_bounded_only_on_request():
    asked = [{"step": "polynomial_features", "columns": ["n"]}, {"step": "interaction_features", "columns": ["n", "m"]}]
    big = dataclasses.replace(BASE, n_rows=10**12)
    assert len(steps.check_features(asked, big, "y")) == 2
    assert steps.check_features(asked, big, "y", steps.Limits(heavy_rows=20_000)) == []
    assert len(steps.check_features(asked, big, "y", steps.Limits(heavy_steps=1))) == 1
    wide = dataclasses.replace(BASE, numeric=[*BASE.numeric, *[f"x{i}" for i in range(20)]])
    assert [s["step"] for s in steps.check_features(asked, wide, "y", steps.Limits(heavy_columns=20))] == ["interaction_features"]


def test_fit_on_training_rows_apply_to_others(spark):
    train = spark.createDataFrame([(1.0, "a", 1), (3.0, "b", 2), (None, "a", 3)], "x double, s string, y int")
    plan = {"cleaning_steps": [{"step": "handle_missing", "columns": ["x"], "method": "mean"}],
            "feature_steps": [{"step": "encode_categorical", "columns": ["s"], "method": "onehot"}]}
    made = prepare.prepare(train, plan, "y")
    assert [tuple(r) for r in made.df.collect()] == [(1.0, 1, False), (3.0, 2, True), (2.0, 3, False)]
    new = spark.createDataFrame([(None, "zz", 9), (7.0, "b", None)], "x double, s string, y int")
    assert [tuple(r) for r in made.apply(new).collect()] == [(2.0, 9, False)]


@pytest.mark.parametrize("method,rows,columns", [("drop_rows", 2, 3), ("drop_cols", 3, 2), ("mode", 3, 3)])
def test_missing_methods_in_a_plan(spark, method, rows, columns):
    df = spark.createDataFrame([(1.0, 1, 1), (3.0, 2, 2), (None, 3, 3)], "x double, z int, y int")
    made = prepare.run_cleaning(df, [{"step": "handle_missing", "columns": ["x", "z"], "method": method}], "y")
    assert (made.df.count(), len(made.df.columns)) == (rows, columns)


def test_every_step_runs(spark):
    df = spark.range(200).selectExpr(
        "double(id % 17) AS n", "id % 5 AS m", "concat('2020-01-', lpad(1 + id % 28, 2, '0')) AS d",
        "string(id % 7) AS t", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 3 END AS g", "1 AS k", "double(id) AS y")
    made = prepare.prepare(df, {
        "cleaning_steps": [
            {"step": "drop_constants", "columns": ["k"]}, {"step": "fix_dtypes", "columns": ["t"]},
            {"step": "handle_missing", "columns": ["g"], "method": "mode"},
            {"step": "remove_outliers", "columns": ["n"], "method": "zscore"},
            {"step": "remove_outliers", "columns": ["m"], "method": "clip"}],
        "feature_steps": [
            {"step": "datetime_decompose", "columns": ["d"]}, {"step": "polynomial_features", "columns": ["n"]},
            {"step": "interaction_features", "columns": ["n", "m"]}, {"step": "log_transform", "columns": ["m"]}]}, "y")
    assert made.df.columns == ["n", "m", "t", "g", "y", "d_year", "d_month", "d_day", "d_dayofweek", "n_pow2", "n_x_m"]
    assert made.df.where(" OR ".join(f"{c} IS NULL" for c in made.df.columns)).count() == 0
    assert made.apply(df).exceptAll(made.df).count() == 0
    assert dict(made.df.dtypes)["t"] == "double" and made.df.agg(F.max("d_day")).first()[0] == 28
