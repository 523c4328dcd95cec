from __future__ import annotations

from millrace.functions.columns import number_names
from millrace.functions.value_counts import cardinality
from millrace.operators import profile as P
from millrace.operators import report, validate

from .derived import cte, derived
from .registry import query, read, rounded, union

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
LINE_ALL = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
DIRTY_ALL = [*LINE_NUMBERS, "l_returnflag", "l_linestatus"]


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def shape(spark, sf_dir):
    return P.shape(read(spark, sf_dir, "lineitem"))


@query("profile_missing", f"WITH {cte('dirty_lineitem')}\n" + union([f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
       round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_pct FROM dirty_lineitem"""
                                                                     for c in DIRTY_ALL]))
def missing(spark, sf_dir):
    return P.missing(derived(spark, sf_dir, "dirty_lineitem"))


def _describe(table: str, columns: list[str], kind: str = "") -> str:
    return union([f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM {table}""" for c in columns])


@query("profile_describe", _describe("lineitem", LINE_NUMBERS))
def describe(spark, sf_dir):
    return rounded(P.describe(read(spark, sf_dir, "lineitem")), "mean", "std", "q25", "q50", "q75")


@query("profile_describe_nulls", f"WITH {cte('dirty_lineitem')}\n" + _describe("dirty_lineitem", ["l_quantity", "l_extendedprice"]))
def describe_nulls(spark, sf_dir):
    return rounded(P.describe(derived(spark, sf_dir, "dirty_lineitem"), ["l_quantity", "l_extendedprice"]),
                   "mean", "std", "q25", "q50", "q75")


@query("profile_cardinality", union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem""" for c in LINE_ALL]))
def cardinalities(spark, sf_dir):
    return cardinality(read(spark, sf_dir, "lineitem"))


@query("profile_high_cardinality", "SELECT * FROM (" + union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM events""" for c in ("event_type", "props")
]) + ") WHERE n_unique > 50")
def high_cardinality(spark, sf_dir):
    return P.high_cardinality(read(spark, sf_dir, "events"))


@query("profile_constant", f"WITH {cte('text_part')} SELECT * FROM (" + union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM text_part"""
    for c in ("p_partkey", "p_brand", "p_type", "p_size_text", "p_retailprice", "k", "z")
]) + ") WHERE n_unique <= 1")
def constant(spark, sf_dir):
    return P.constant_columns(derived(spark, sf_dir, "text_part"))


@query("profile_duplicates", f"""
WITH {cte("dup_orders")}
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM dup_orders GROUP BY ALL)
""".replace("SELECT count(*) AS n FROM dup_orders GROUP BY ALL",
            "SELECT count(*) AS n FROM dup_orders GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"))
def duplicates(spark, sf_dir):
    return P.duplicate_rows(derived(spark, sf_dir, "dup_orders"))


def _skew(table: str, columns: list[str]) -> str:
    return union([f"""SELECT '{c}' AS "column", round(skewness({c}), 4) AS skew,
       coalesce(abs(skewness({c})) > 1.0, FALSE) AS is_skewed FROM {table}""" for c in columns])


@query("profile_skew", f"WITH {cte('dirty_lineitem')}\n" + _skew("dirty_lineitem", LINE_NUMBERS))
def skew(spark, sf_dir):
    return rounded(P.skew(derived(spark, sf_dir, "dirty_lineitem")), "skew")


@query("profile_skew_events", _skew("events", ["event_id", "user_id", "value"]))
def skew_events(spark, sf_dir):
    return rounded(P.skew(read(spark, sf_dir, "events")), "skew")


@query("profile_top_values", "SELECT \"column\", value, n, round(share, 6) AS share FROM (" + union([f"""
SELECT '{c}' AS "column", {c} AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
       row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM events WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in ("event_type", "props")]) + ") WHERE r <= 5")
def top_values(spark, sf_dir):
    return rounded(P.top_values(read(spark, sf_dir, "events")), "share", digits=6)


def _pearson(a: str, b: str) -> str:
    return (f"covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) "
            f"* stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")


@query("profile_target_correlation", f"WITH {cte('dirty_lineitem')}\n" + union([
    f"""SELECT '{c}' AS "column", round({_pearson(c, 'l_extendedprice')}, 6) AS r FROM dirty_lineitem"""
    for c in LINE_NUMBERS if c != "l_extendedprice"]))
def target_correlation(spark, sf_dir):
    return rounded(P.target_correlation(derived(spark, sf_dir, "dirty_lineitem"), "l_extendedprice"), "r", digits=6)


@query("profile_target_numeric", f"""
WITH {cte("dirty_lineitem")}
SELECT round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min,
       max(l_quantity) AS max, count(DISTINCT l_quantity) AS n_unique FROM dirty_lineitem
""")
def target_numeric(spark, sf_dir):
    return rounded(P.target_summary(derived(spark, sf_dir, "dirty_lineitem"), "l_quantity"), "mean", "std")


@query("profile_target_text", """
SELECT props AS value, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, value LIMIT 10
""")
def target_text(spark, sf_dir):
    return P.target_summary(read(spark, sf_dir, "events"), "props")


@query("profile_column_context", union([
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS n_unique FROM orders"""
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))]))
def column_context(spark, sf_dir):
    return P.column_context(read(spark, sf_dir, "orders"))


@query("profile_missing_cells", f"""
WITH {cte("dirty_lineitem")}
SELECT count(*) FILTER (WHERE l_quantity IS NULL) + count(*) FILTER (WHERE l_returnflag IS NULL) AS missing_cells
FROM dirty_lineitem
""")
def missing_cells(spark, sf_dir):
    return P.missing_cells(derived(spark, sf_dir, "dirty_lineitem"))


@query("profile_table", "WITH d AS (" + _describe("lineitem", LINE_NUMBERS) + "), s AS (" + _skew("lineitem", LINE_NUMBERS)
       + "), c AS (" + union([f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, '{k}' AS kind,
       count(*) FILTER (WHERE {c} IS NULL) AS missing,
       round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_pct,
       count(DISTINCT {c}) AS n_unique FROM lineitem""" for i, (c, t, k) in enumerate(
           [(c, "bigint", "number") for c in LINE_NUMBERS[:3]] + [("l_linenumber", "int", "number")]
           + [(c, "double", "number") for c in LINE_NUMBERS[4:]]
           + [("l_returnflag", "string", "text"), ("l_linestatus", "string", "text"),
              ("l_shipdate", "timestamp_ntz", "other")])]) + """)
SELECT c.*, d."count", d.mean, d.std, d.min, d.q25, d.q50, d.q75, d.max, s.skew, s.is_skewed,
       n_unique <= 1 AS is_constant, kind = 'text' AND n_unique > 50 AS is_high_cardinality
FROM c LEFT JOIN d ON c."column" = d."column" LEFT JOIN s ON c."column" = s."column"
""")
def profile_table(spark, sf_dir):
    return rounded(P.profile_table(read(spark, sf_dir, "lineitem")), "mean", "std", "q25", "q50", "q75", "skew")


@query("report_overview", f"""
WITH {cte("dup_orders")}, {cte("raw_events")}
SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) FILTER (WHERE value IS NULL) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_events)) AS duplicate_rows,
       CAST(4 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS text_columns FROM raw_events
""")
def overview(spark, sf_dir):
    return report.overview(derived(spark, sf_dir, "raw_events"))


TASKS = {"l_quantity": False, "l_tax": False, "l_linenumber": False, "l_returnflag": True, "l_extendedprice": False}


@query("target_task", union([
    f"""SELECT '{c}' AS "column", CASE WHEN {str(text).upper()} OR count(DISTINCT {c}) <= 20 THEN 'classification'
       ELSE 'regression' END AS task FROM lineitem""" for c, text in TASKS.items()]))
def target_task(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, validate.infer_task(df, c)) for c in TASKS], "column string, task string")


# Validation ----------------------------------------------------------------------

@query("validate_target_nulls", f"""
WITH {cte("dirty_lineitem")}
SELECT round(avg(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END), 6) AS null_share,
       avg(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) > 0.5 AS too_many_nulls FROM dirty_lineitem
""")
def target_nulls(spark, sf_dir):
    return rounded(validate.target_null_share(derived(spark, sf_dir, "dirty_lineitem"), "l_quantity"),
                   "null_share", digits=6)


@query("validate_class_count", """
SELECT count(DISTINCT p_name) AS n_classes, count(DISTINCT p_name) > 50 AS too_many_classes FROM part
""")
def class_count(spark, sf_dir):
    return validate.class_count(read(spark, sf_dir, "part"), "p_name")


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


@query("validate_numeric_text", f"WITH {cte('text_part')}\n" + union([f"""
SELECT '{c}' AS "column", round(share, 6) AS parsed_share, coalesce(share > 0.9, FALSE) AS is_numeric_text
FROM (SELECT count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) / nullif(count({c}), 0) AS share FROM text_part)"""
                                                                       for c in ("p_brand", "p_type", "p_size_text", "z")]))
def numeric_text(spark, sf_dir):
    return rounded(validate.numeric_text(derived(spark, sf_dir, "text_part")), "parsed_share", digits=6)


def _id_test(table: str, order: str, numbers: dict[str, str], texts: list[str]) -> str:
    parts = [f"""
SELECT '{c}' AS "column" FROM (
  SELECT count(DISTINCT {c}) / count(*) AS ratio, count(*) FILTER (WHERE v < before) AS falls
  FROM (SELECT {c}, {v} AS v, lag({v}) OVER (ORDER BY {order}) AS before FROM {table})
) WHERE ratio > 0.98 AND falls = 0""" for c, v in numbers.items()]
    parts += [f"""
SELECT '{c}' AS "column" FROM (
  SELECT count(DISTINCT {c}) / count(*) AS ratio, count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) AS parsed
  FROM {table}) WHERE ratio > 0.98 AND parsed = 0""" for c in texts]
    return union(parts)


@query("validate_ids", _id_test("orders", "o_orderkey", {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_totalprice": "o_totalprice",
    "o_orderdate": "epoch_us(o_orderdate)"}, ["o_orderstatus", "o_orderpriority"]))
def ids(spark, sf_dir):
    found = validate.id_columns(read(spark, sf_dir, "orders"), order_by=["o_orderkey"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("validate_ids_events", _id_test("events", "event_id", {
    "event_id": "event_id", "user_id": "user_id", "ts": "epoch_us(ts)", "value": "value"}, ["event_type", "props"]))
def ids_events(spark, sf_dir):
    found = validate.id_columns(read(spark, sf_dir, "events"), order_by=["event_id"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("validate_ids_file_order", "WITH t AS (SELECT *, row_number() OVER () AS place FROM orders)" + _id_test("t", "place", {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_totalprice": "o_totalprice",
    "o_orderdate": "epoch_us(o_orderdate)"}, ["o_orderstatus", "o_orderpriority"]))
def ids_file_order(spark, sf_dir):
    """Without a named order: that of the rows in the file."""
    return spark.createDataFrame([(c,) for c in validate.id_columns(read(spark, sf_dir, "orders"))], "column string")


@query("validate_report", f"""
WITH {cte("wide_customer")}, s AS (
  SELECT count(*) AS n, count(DISTINCT alias) AS a, count(DISTINCT alias_code) AS ac, count(DISTINCT c_name) AS nm,
         count(DISTINCT c_custkey) AS ck, count(nothing) AS filled,
         count(*) FILTER (WHERE regexp_matches(balance_text, '{NUMBER}')) AS parsed FROM wide_customer)
SELECT 'balance_text' AS "column", 'numeric_text' AS "check", 'convert_to_numeric' AS action FROM s WHERE parsed / n > 0.9
UNION ALL SELECT 'c_custkey', 'id', 'drop_id' FROM s WHERE ck / n > 0.98
UNION ALL SELECT 'c_name', 'id', 'drop_id' FROM s WHERE nm / n > 0.98
UNION ALL SELECT 'alias', 'high_cardinality', 'drop_high_cardinality' FROM s WHERE a / n > 0.5 AND a / n <= 0.98
UNION ALL SELECT 'alias_code', 'high_cardinality_kept', NULL FROM s WHERE ac / n > 0.5 AND ac / n <= 0.98
UNION ALL SELECT 'nothing', 'all_null', 'drop_null_col' FROM s WHERE filled = 0
""")
def validation_report(spark, sf_dir):
    df = derived(spark, sf_dir, "wide_customer")
    return validate.validate(df, "c_nationkey", order_by=["c_custkey"]).table(df).drop("detail")


@query("validate_high_cardinality", f"""
WITH {cte("wide_customer")}
SELECT 'alias' AS "column", count(DISTINCT alias) AS n_unique FROM wide_customer
HAVING count(DISTINCT alias) / count(*) > 0.5
""")
def wide_text(spark, sf_dir):
    df = derived(spark, sf_dir, "wide_customer")
    fixes = validate.validate(df, "c_nationkey", order_by=["c_custkey"]).fixes
    return cardinality(df, [c for c, fix in fixes.items() if fix == "drop_high_cardinality"])


@query("validate_all_null", f"""
WITH {cte("text_part")} SELECT 'z' AS "column" FROM text_part HAVING count(z) = 0
""")
def all_null(spark, sf_dir):
    df = derived(spark, sf_dir, "text_part")
    fixes = validate.validate(df, "p_retailprice", order_by=["p_partkey"]).fixes
    return spark.createDataFrame([(c,) for c, fix in fixes.items() if fix == "drop_null_col"], "column string")


@query("validate_apply_fixes", f"""
WITH {cte("text_part")}
SELECT p_brand, p_type, CASE WHEN p_size_text = 'n/a' THEN NULL ELSE CAST(p_size_text AS DOUBLE) END AS p_size_text,
       p_retailprice, k FROM text_part
""")
def apply_fixes(spark, sf_dir):
    df = derived(spark, sf_dir, "text_part")
    return validate.apply_fixes(df, validate.validate(df, "p_retailprice", order_by=["p_partkey"]).fixes)


NAN_VALUE = "CASE WHEN l_orderkey % 7 = 0 THEN {nan} WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END"


@query("describe_nan", f"WITH t AS (SELECT {NAN_VALUE.format(nan='NULL')} AS v FROM lineitem)" + _describe("t", ["v"]))
def describe_nan(spark, sf_dir):
    """NaN counts as missing in every statistic."""
    df = read(spark, sf_dir, "lineitem").selectExpr(NAN_VALUE.format(nan="double('NaN')") + " AS v")
    return rounded(P.describe(df), "mean", "std", "q25", "q50", "q75")


# Above 2 ** 53, where doubles skip whole numbers: one rises with the key, one falls by 1 within each pair of keys.
LONG_IDS = ["o_orderkey", "1234567890123450000 + o_orderkey AS up", "1234567890123450000 + o_orderkey + 2 * (o_orderkey % 2) AS down"]


@query("validate_ids_long", f"WITH t AS (SELECT {', '.join(LONG_IDS)} FROM orders)" + _id_test(
    "t", "o_orderkey", {c: c for c in ("o_orderkey", "up", "down")}, []))
def ids_long(spark, sf_dir):
    found = validate.id_columns(read(spark, sf_dir, "orders").selectExpr(*LONG_IDS), order_by=["o_orderkey"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("validate_duplicate_names", """
SELECT 'value' AS "column", 'duplicate_name' AS "check" WHERE (SELECT count(*) FROM events) > 0
""")
def duplicate_names(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    twice = df.select("event_id", "user_id", "value", df["user_id"].alias("value"))
    issues = validate.validate(twice, "user_id").issues
    return spark.createDataFrame([i[:2] for i in issues if i[1] == "duplicate_name"], "column string, check string")
