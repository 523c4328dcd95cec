"""The bootstrap band of a trend."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import charts


def test_weights_follow_the_poisson_law():
    weights = charts._poisson_weights()
    assert weights.mean() == pytest.approx(1, abs=1e-3) and weights.var() == pytest.approx(1, abs=1e-2)
    assert (weights == 0).mean() == pytest.approx(np.exp(-1), abs=1e-4)


def test_band_matches_the_closed_form(spark):
    """For a line with even noise both bands agree; gaps and repeated partitions change nothing."""
    df = spark.range(4000).selectExpr("id", "double(id % 100) AS x", "IF(id % 41 = 0, NULL, 2D * (id % 100) + 5 + 30 * (rand(3) - 0.5)) AS y")
    band = charts.bootstrap_band(df, "x", "y", ["id"], replicates=400, points=9).orderBy("x").collect()
    closed = charts.trend_band(df, "x", "y", points=9).orderBy("x").collect()
    assert [r.fitted for r in band] == pytest.approx([r.fitted for r in closed])
    assert [r.upper - r.lower for r in band] == pytest.approx([r.upper - r.lower for r in closed], rel=0.15)
    again = charts.bootstrap_band(df.repartition(7), "x", "y", ["id"], replicates=400, points=9).orderBy("x").collect()
    assert [r.lower for r in again] == pytest.approx([r.lower for r in band])


def test_degenerate(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 5.0), (3, None, 1.0)], "id int, x double, y double")
    assert all(r.lower is None and r.upper is None for r in charts.bootstrap_band(one, "x", "y", ["id"], 5, 3).collect())
    assert all(r.slope is None for r in charts.bootstrap_lines(one.limit(0), "x", "y", ["id"], 5).collect())
