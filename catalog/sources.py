from __future__ import annotations

from millrace.functions.storage import shared_dir
from millrace.sources import sinks, tables
from pyspark.sql import functions as F

from .derived import cte, derived
from .registry import query, read

import uuid


def _scratch(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("scan_csv", f"""
WITH {cte("text_part")}
SELECT p_partkey, p_brand, p_type, p_retailprice, CAST(k AS BIGINT) AS k, z,
       CASE WHEN p_size_text = 'n/a' THEN NULL ELSE CAST(p_size_text AS BIGINT) END AS p_size_text
FROM (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS z) FROM text_part)
""")
def scan_csv(spark, sf_dir):
    path = _scratch(spark, "part") + ".csv"
    derived(spark, sf_dir, "text_part").write.option("header", True).csv(path)
    return tables.load(spark, path)


@query("scan_json", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
""")
def scan_json(spark, sf_dir):
    path = _scratch(spark, "orders") + ".jsonl"
    read(spark, sf_dir, "orders").drop("o_orderdate").write.json(path)
    return tables.load(spark, path)


@query("scan_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def scan_parquet(spark, sf_dir):
    return tables.load(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("preview_rows", """
SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey,
       coalesce(CAST(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS STRING), '') AS o_totalprice,
       o_orderstatus
FROM orders ORDER BY orders.o_orderkey LIMIT 5
""")
def preview_rows(spark, sf_dir):
    gaps = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END").alias("o_totalprice")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", gaps, "o_orderstatus")
    return tables.preview(rows, ["o_orderkey"])


@query("preview_schema", """
SELECT c AS "column", dtype, (SELECT count(*) FROM events) AS n_rows, CAST(6 AS BIGINT) AS n_columns
FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'),
             ('value', 'double'), ('props', 'string')) AS t(c, dtype)
""")
def preview_schema(spark, sf_dir):
    return tables.preview_schema(read(spark, sf_dir, "events"))


@query("write_results", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type
""")
def write_results(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    paths = sinks.write_tables({"counts by type": counts}, _scratch(spark, "results"))
    return tables.read_parquet(spark, paths["counts by type"])


LONG_IDS = ["o_orderkey", "CAST(CAST(1234567890123456789 AS DECIMAL(38, 0)) + o_orderkey AS STRING) AS snowflake",
            "CAST(CAST(12345678901234567890 AS DECIMAL(38, 0)) + o_orderkey AS STRING) AS longer"]


@query("scan_csv_long_ids", """
SELECT o_orderkey, 1234567890123456789 + o_orderkey AS snowflake,
       CAST(CAST(12345678901234567890 AS DECIMAL(38, 0)) + o_orderkey AS STRING) AS longer FROM orders
""")
def scan_csv_long_ids(spark, sf_dir):
    """Whole numbers keep all their digits: 19 as bigint, more as decimal."""
    path = _scratch(spark, "long-ids") + ".csv"
    read(spark, sf_dir, "orders").selectExpr(*LONG_IDS).write.option("header", True).csv(path)
    return tables.load(spark, path).withColumn("longer", F.col("longer").cast("string"))


@query("scan_json_array", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
       'a "quoted" } ] ' || o_orderstatus || chr(10) || chr(92) || '{[' AS note, o_orderkey % 7 AS inner_key
FROM orders
""")
def scan_json_array(spark, sf_dir):
    """One array of all orders in a single file, cut in many tasks."""
    note = F.concat(F.lit('a "quoted" } ] '), "o_orderstatus", F.lit("\n\\{["))
    rows = read(spark, sf_dir, "orders").drop("o_orderdate").withColumns({"note": note, "inner": F.array(F.struct((F.col("o_orderkey") % 7).alias("key")))})
    path = _one_file(rows.select(F.to_json(F.struct("*")).alias("value")), "[", ",", "]", ".json")
    found = tables.load(spark, path)
    return found.select(*[c for c in found.columns if c != "inner"], F.col("inner")[0]["key"].alias("inner_key"))


@query("scan_csv_multiline", """
SELECT o_orderkey, 'first, ' || o_orderpriority || chr(10) || 'second "' || o_orderstatus || '"' || chr(10) AS note, o_totalprice
FROM orders
""")
def scan_csv_multiline(spark, sf_dir):
    """Line breaks, separators and quotes in quoted fields of a single file, read by default options."""
    note = F.concat(F.lit("first, "), "o_orderpriority", F.lit('\nsecond "'), "o_orderstatus", F.lit('"\n'))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), quoted, F.col("o_totalprice").cast("string")).alias("value"))
    return tables.load(spark, _one_file(lines, "o_orderkey,note,o_totalprice\n", "", "", ".csv"))


def _one_file(lines, before: str, between: str, after: str, suffix: str) -> str:
    """The lines as one file in a new folder, as the tests' tables come in one file each."""
    spark = lines.sparkSession
    folder = _scratch(spark, "one-file") + suffix
    # the opening goes in front of the first line and the end behind the last; no text is gathered on the driver
    numbered = lines.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    last = numbered.agg(F.max("at")).first()[0]
    edged = F.concat(F.when(F.col("at") == 0, before).otherwise(between), "value", F.when(F.col("at") == last, after).otherwise(""))
    numbered.select(edged.alias("value")).write.option("lineSep", "\n" if suffix == ".csv" else " ").text(folder)
    return folder
