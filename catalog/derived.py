"""Dirty variants of the test tables, from select lists valid in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import read

TITLES = "CASE c_custkey % 6 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' WHEN 2 THEN 'Miss' WHEN 3 THEN 'Master' WHEN 4 THEN 'Dr' ELSE 'Xx' END"

# name -> (source table, select list)
TABLES: dict[str, tuple[str, list[str]]] = {
    "dirty_lineitem": ("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice",
        "l_discount", "l_tax",
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
        "l_linestatus",
    ]),
    "text_part": ("part", [
        "p_partkey", "p_brand", "p_type",
        "CASE WHEN p_partkey % 40 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS p_size_text",
        "p_retailprice", "1 AS k", "CAST(NULL AS STRING) AS z",
    ]),
    "dated_orders": ("orders", [
        "o_orderkey", "o_totalprice",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_date",
        "CASE WHEN o_orderkey % 3 > 0 THEN 'no date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_rare_date",
    ]),
    "people": ("customer", [
        "c_custkey", f"'S' || CAST(c_custkey % 60 AS STRING) || ', ' || {TITLES} || '. X' AS name",
        "CAST(c_custkey % 4 AS INT) AS sibsp", "CAST(c_custkey % 3 AS INT) AS parch",
        "CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS `S-E X`",
        "c_acctbal", "c_mktsegment", "c_nationkey",
    ]),
    "wide_customer": ("customer", [
        "c_custkey", "c_name", "c_nationkey",
        "CASE WHEN c_custkey % 5 < 2 THEN 'shared' ELSE c_name END AS alias",
        "CASE WHEN c_custkey % 5 < 2 THEN 'shared' ELSE c_name END AS alias_code",
        "CAST(c_acctbal AS STRING) AS balance_text", "CAST(NULL AS STRING) AS nothing",
    ]),
    "predictions": ("lineitem", [
        "l_orderkey", "l_extendedprice AS y", "l_quantity * 2000 + 1500 AS p",
    ]),
    "class_predictions": ("events", [
        "event_id", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y", "value AS score",
        "CASE WHEN value > 40 THEN 1 ELSE 0 END AS p",
    ]),
    "multi_predictions": ("events", [
        "event_id",
        "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS y",
        "CASE WHEN value > 60 THEN 0 WHEN value > 30 THEN 1 WHEN value > 10 THEN 2 ELSE 3 END AS p",
        "value AS s0", "user_id AS s1", "value * 2 - user_id AS s2", "-value AS s3",
    ]),
    "scored_orders": ("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "dup_orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    "raw_events": ("events", [
        "event_id", "user_id", "event_type", "props",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value", "1 AS k",
    ]),
}
# rows repeated once more
COPIES = {"dup_orders": "o_orderkey % 50 = 0", "raw_events": "event_id % 25 = 0"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    out = read(spark, sf_dir, source).selectExpr(*columns)
    return out.unionAll(out.where(COPIES[name])) if name in COPIES else out


def cte(name: str) -> str:
    """``name AS (SELECT ...)`` for DuckDB."""
    source, columns = TABLES[name]
    body = f"SELECT {', '.join(columns)} FROM {source}".replace("`", '"')
    if name in COPIES:
        body = f"SELECT * FROM ({body}) UNION ALL SELECT * FROM ({body}) WHERE {COPIES[name]}"
    return f"{name} AS ({body})"
