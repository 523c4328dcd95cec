"""Plan shapes that have to hold on large tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import checkall  # noqa: F401
from catalog.registry import read
from millrace.functions.value_counts import cardinality
from millrace.operators import charts, features, folds, metrics, profile


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def big_window(text: str) -> bool:
    """A window right above an exchange to one partition."""
    return bool(re.search(r"Window(?!GroupLimit)[^\n]*\n(?:[^\n]*\n){0,2}[^\n]*Exchange SinglePartition", text))


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def test_scans_read_only_what_is_asked(lines):
    text = plan(features.log_transform(lines, ["l_tax"]).where("l_quantity > 49").select("l_tax"))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    assert "GreaterThan(l_quantity,49.0)" in text


def test_profile_aggregates_before_the_shuffle(lines):
    text = plan(profile.missing(lines))
    assert text.count("Exchange") == 1 and "partial_" in text
    text = plan(cardinality(lines))
    assert "partial_count" not in text or "HashAggregate" in text
    assert "Expand" not in text


def test_top_values_limits_groups_before_ranking(lines):
    text = plan(profile.top_values(lines))
    assert "row_number(), 5, Partial" in text


def test_projections_do_not_shuffle(lines):
    made = features.interactions(features.powers(lines, ["l_quantity"]), ["l_tax", "l_discount"])
    assert "Exchange" not in plan(made.withColumn("fold", folds.hash_fold(["l_orderkey"])))


def test_folds_and_split_move_no_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    for made in (folds.ordered_folds(orders, "o_orderkey", label="o_orderstatus"),
                 folds.train_test_split(orders, ["o_orderkey"], label="o_orderstatus")):
        text = plan(made)
        assert "Exchange hashpartitioning" not in text and "rangepartitioning" not in text


def test_no_one_task_windows(spark, sf_dir, lines):
    events = read(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    for made in (metrics.roc_auc(events, "y", "value"), profile.top_values(lines),
                 features.label_encode(events, ["value"], broadcast_levels=5)):
        text = plan(made)
        for hit in re.finditer(r"Exchange SinglePartition[^\n]*\n([^\n]*)", text):
            assert "HashAggregate" in hit.group(1) or "_part" in text


def test_top_levels_takes_ordered(lines):
    assert "TakeOrderedAndProject" in plan(charts.top_levels(lines, "l_returnflag", 3))


def test_metrics_need_no_python(lines):
    made = metrics.classification_scores(lines, "l_linenumber", "l_linenumber")
    assert "Python" not in plan(made) and "InPandas" not in plan(made)
