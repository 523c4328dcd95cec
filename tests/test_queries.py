"""Every registered query against the same question asked of DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import checkall
from catalog.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    assert checkall.compare(spark, duck, sf_dir, name) == ""


def test_sql_belongs_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_one_row_per_column(spark):
    assert entry_points.entry(spark).count() == 11
