"""Exact quantiles by refinement against numpy."""

from __future__ import annotations

import decimal

import numpy as np
import pytest

from millrace.functions.order_stats import order_statistics, quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
RNG = np.random.default_rng(7)
CASES = {
    "normal": RNG.normal(size=5000),
    "mixed_scales": np.concatenate([RNG.normal(size=1000) * 10.0 ** RNG.integers(-200, 200, 1000), np.zeros(100)]),
    "hot_value": np.concatenate([np.full(3000, 4.25), RNG.uniform(-1, 10, 6000)]),
    "constant": np.full(50, -3.5),
    "one": np.array([2.0]),
    "neighbours": np.nextafter(1.0, 2.0) ** np.arange(1, 40),
    "tiny": np.array([5e-324, 1e-300, 0.0, -5e-324, 1.0]),
    "outlier": np.append(RNG.uniform(0, 1, 999), 1e300),
}


@pytest.mark.parametrize("name", CASES)
def test_doubles(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = quantiles(df, ["v"], PROBS)["v"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_longs_beyond_double_precision(spark):
    base = 2**62
    values = [base + i for i in range(100)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    found = order_statistics(df, ["v"], lambda n: list(range(n)))
    assert found[(0, "v")] == (102, sorted(values))


def test_decimals(spark):
    values = [decimal.Decimal(i) / 100 for i in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(12,2)")
    found = order_statistics(df, ["v"], lambda n: [0, 499, n - 1])
    assert found[(0, "v")][1] == [values[0], values[499], values[-1]]


def test_groups_with_one_holding_most_rows(spark):
    rows = [("hot", float(v)) for v in RNG.integers(0, 50, 3000)] + [("a", float(v)) for v in range(11)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = quantiles(df, ["v"], (0.25, 0.5), "g")
    hot = np.array([v for g, v in rows if g == "hot"])
    assert got[("a", "v")] == [2.5, 5.0]
    assert got[("hot", "v")] == list(np.quantile(hot, (0.25, 0.5)))
    assert len(got) == 2


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles(df, ["v"], (0.5,)) == {"v": [None]}
    assert quantiles(df.limit(0), ["v"], (0.5,)) == {"v": [None]}


def test_infinities(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "v double")
    found = order_statistics(df, ["v"], lambda n: [0, 1, 2])
    assert found[(0, "v")][1] == [float("-inf"), 1.0, float("inf")]


def test_large_integers_start_from_their_ends(spark):
    values = sorted(int(v) for v in RNG.integers(2**54, 2**60, 3000))
    rows = [("a", v) for v in values] + [("b", 2**55), (None, 1)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    found = order_statistics(df, ["v"], lambda n: [0, n // 3, n - 1], "g")
    assert found == {("a", "v"): (3000, [values[0], values[1000], values[-1]]), ("b", "v"): (1, [2**55] * 3)}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i) if i % 3 else float("nan"),) for i in range(3000)] + [(None,), (-0.0,)], "v double")
    values = [float(i) for i in range(3000) if i % 3] + [0.0]
    np.testing.assert_allclose(quantiles(df, ["v"], PROBS)["v"], np.quantile(values, PROBS))
