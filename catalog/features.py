from __future__ import annotations

from millrace.operators import features as FE
from millrace.operators import charts
from millrace.plans import prepare, steps
from millrace.operators.profile import profile
from pyspark.sql import functions as F

from .derived import cte, derived
from .registry import query, read, rounded

DIRTY = "dirty_lineitem"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)


def code(column: str) -> str:
    """Dense position of a value among the sorted distinct ones; -1 for null."""
    return (f"CAST(CASE WHEN {column} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {column} NULLS LAST) - 1 END "
            f"AS INTEGER)")


@query("encode_label", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, {code("l_returnflag")} AS l_returnflag, {code("l_linestatus")} AS l_linestatus FROM {DIRTY}
""")
def encode_label(spark, sf_dir):
    out = FE.encode(derived(spark, sf_dir, DIRTY), ["l_returnflag", "l_linestatus"], "label")
    return out.select(*KEYS, "l_returnflag", "l_linestatus")


@query("encode_label_long", f"""
SELECT o_orderkey, {code("o_totalprice")} AS o_totalprice FROM orders
""")
def encode_label_long(spark, sf_dir):
    """The path for columns with too many levels to broadcast."""
    out = FE.label_encode(read(spark, sf_dir, "orders"), ["o_totalprice"], broadcast_levels=1000)
    return out.select("o_orderkey", "o_totalprice")


@query("encode_onehot", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, coalesce(l_returnflag = 'N', FALSE) AS "l_returnflag_N",
       coalesce(l_returnflag = 'R', FALSE) AS "l_returnflag_R" FROM {DIRTY}
""")
def encode_onehot(spark, sf_dir):
    out = FE.encode(derived(spark, sf_dir, DIRTY), ["l_returnflag"], "onehot")
    return out.select(*KEYS, "l_returnflag_N", "l_returnflag_R")


@query("encode_onehot_sparse", """
WITH a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)),
b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_partkey % 5 > 0))
SELECT l_orderkey, l_linenumber, CAST(a.code - 1 AS INTEGER) AS slot FROM lineitem JOIN a ON l_returnflag = v WHERE a.code > 0
UNION ALL
SELECT l_orderkey, l_linenumber, CAST(b.code - 1 + (SELECT max(code) FROM a) AS INTEGER) FROM lineitem JOIN b ON l_partkey = v WHERE b.code > 0
""")
def encode_onehot_sparse(spark, sf_dir):
    """Slots of a short and of a long column with gaps, the long one numbered range by range."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "IF(l_partkey % 5 > 0, l_partkey, NULL) AS part")
    levels = FE.fit_sparse_levels(lines, ["l_returnflag", "part"], broadcast_levels=10)
    return FE.one_hot_slots(lines, ["l_returnflag", "part"], levels).select("l_orderkey", "l_linenumber", F.explode("slots").alias("slot"))


@query("encode_sex", f"""
WITH {cte("people")}
SELECT c_custkey, CAST("S-E X" = 'male' AS INTEGER) AS sex,
       c_mktsegment = 'BUILDING' AS b, c_mktsegment = 'FURNITURE' AS f, c_mktsegment = 'HOUSEHOLD' AS h,
       c_mktsegment = 'MACHINERY' AS m FROM people
""")
def encode_sex(spark, sf_dir):
    out = FE.encode(derived(spark, sf_dir, "people"), ["S-E X", "c_mktsegment"], "onehot")
    return out.select("c_custkey", F.col("`S-E X`").alias("sex"), *[
        F.col(f"c_mktsegment_{v}").alias(v[0].lower()) for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])


@query("log_transform", """
SELECT c_custkey, c_acctbal, round(ln(1 + c_nationkey), 6) AS c_nationkey FROM customer
""")
def log_transform(spark, sf_dir):
    out = FE.log_transform(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_name"])
    return rounded(out.select("c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey", digits=6)


@query("polynomial_features", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, l_quantity * l_quantity AS l_quantity_pow2, l_extendedprice * l_extendedprice AS l_extendedprice_pow2,
       CAST(l_orderkey AS DOUBLE) * l_orderkey AS l_orderkey_pow2 FROM {DIRTY}
""")
def polynomial_features(spark, sf_dir):
    out = FE.powers(derived(spark, sf_dir, DIRTY), ["l_quantity", "l_returnflag", "l_extendedprice", "l_orderkey"], 3)
    return out.select(*KEYS, "l_quantity_pow2", "l_extendedprice_pow2", "l_orderkey_pow2")


PAIR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"]
PAIRS = [(a, b) for i, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[i + 1:]]


@query("interaction_features", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, {", ".join(f"CAST({a} AS DOUBLE) * {b} AS {a}_x_{b}" for a, b in PAIRS)} FROM {DIRTY}
""")
def interaction_features(spark, sf_dir):
    out = FE.interactions(derived(spark, sf_dir, DIRTY), PAIR_COLUMNS)
    made = [c for c in out.columns if "_x_" in c]
    return out.select(*KEYS, *made)


@query("date_parts", f"""
WITH {cte("dated_orders")}, t AS (SELECT *, try_cast(o_date AS TIMESTAMP) AS t FROM dated_orders)
SELECT o_orderkey, o_totalprice, o_rare_date, CAST(year(t) AS INTEGER) AS o_date_year,
       CAST(month(t) AS INTEGER) AS o_date_month, CAST(day(t) AS INTEGER) AS o_date_day,
       CAST(isodow(t) - 1 AS INTEGER) AS o_date_dayofweek, CAST(hour(t) AS INTEGER) AS o_date_hour FROM t
""")
def date_parts(spark, sf_dir):
    return FE.date_parts(derived(spark, sf_dir, "dated_orders"), ["o_date", "o_rare_date"])


@query("date_parts_timestamp", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
       CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek,
       CAST(hour(ts) AS INTEGER) AS ts_hour FROM events
""")
def date_parts_timestamp(spark, sf_dir):
    return FE.date_parts(read(spark, sf_dir, "events").select("event_id", "ts"), ["ts"])


GROUP = """CASE trim(regexp_extract(name, ',\\s*([^.]+)\\.', 1)) WHEN 'Mr' THEN 'Mr' WHEN 'Mrs' THEN 'Mrs'
  WHEN 'Miss' THEN 'Miss' WHEN 'Master' THEN 'Master' ELSE 'Rare' END"""


@query("name_titles", f"""
WITH {cte("people")}, g AS (SELECT *, {GROUP} AS title FROM people)
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY title) - 1 AS INTEGER) AS name_title FROM g
""")
def name_titles(spark, sf_dir):
    out = FE.name_titles(derived(spark, sf_dir, "people"), ["name", "c_mktsegment"])
    assert "c_mktsegment" in out.columns and "name" not in out.columns
    return out.select("c_custkey", "name_title")


@query("family_size", f"""
WITH {cte("people")}
SELECT c_custkey, sibsp + parch + 1 AS "FamilySize", CAST(sibsp + parch = 0 AS INTEGER) AS "IsAlone" FROM people
""")
def family_size(spark, sf_dir):
    return FE.family_size(derived(spark, sf_dir, "people")).select("c_custkey", "FamilySize", "IsAlone")


@query("encode_leftover", f"""
SELECT event_id, {code("event_type")} AS event_type, {code("props")} AS props FROM events
""")
def encode_leftover(spark, sf_dir):
    return FE.encode_leftover(read(spark, sf_dir, "events"), "value").select("event_id", "event_type", "props")


PEOPLE_STEPS = [
    {"step": "log_transform", "columns": ["sibsp", "c_acctbal"]},
    {"step": "interaction_features", "columns": ["c_acctbal", "parch"]},
    {"step": "polynomial_features", "columns": ["parch"], "degree": 2},
    {"step": "encode_categorical", "columns": ["c_mktsegment"], "method": "ordinal"},
    {"step": "unheard_of", "columns": ["parch"]},
]


@query("feature_plan", f"""
WITH {cte("people")}, g AS (SELECT *, {GROUP} AS title FROM people)
SELECT c_custkey, round(ln(1 + sibsp), 6) AS sibsp, parch, CAST("S-E X" = 'male' AS INTEGER) AS "S-E X", c_acctbal,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment, c_nationkey,
       c_acctbal * parch AS c_acctbal_x_parch, CAST(parch AS DOUBLE) * parch AS parch_pow2,
       CAST(dense_rank() OVER (ORDER BY title) - 1 AS INTEGER) AS name_title,
       round(ln(1 + sibsp) + parch + 1, 6) AS "FamilySize", CAST(sibsp + parch = 0 AS INTEGER) AS "IsAlone" FROM g
""")
def feature_plan(spark, sf_dir):
    out = prepare.run_features(derived(spark, sf_dir, "people"), PEOPLE_STEPS, "c_nationkey").df
    return rounded(out, "sibsp", "FamilySize", digits=6)


@query("feature_matrix", f"""
WITH {cte(DIRTY)}
SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in KEYS)}, coalesce(l_quantity, 0) AS l_quantity, l_extendedprice,
       l_discount, CAST(l_quantity > 10 IS TRUE AS DOUBLE) AS big, l_tax FROM {DIRTY}
""")
def feature_matrix(spark, sf_dir):
    df = derived(spark, sf_dir, DIRTY).withColumn("big", F.col("l_quantity") > 10)
    return FE.feature_matrix(df, "l_tax")


# Plans -----------------------------------------------------------------------

@query("auto_prepare", f"""
WITH {cte("raw_events")}, m AS (SELECT median(value) AS v, count(*) AS n FROM raw_events),
filled AS (SELECT DISTINCT event_id, user_id, event_type, props, coalesce(value, m.v) AS value, m.n FROM raw_events, m)
SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type,
       CAST(dense_rank() OVER (ORDER BY props) - 1 AS INTEGER) AS props,
       round(ln(1 + value), 6) AS value FROM filled
""")
def auto_prepare(spark, sf_dir):
    out = prepare.auto_prepare(derived(spark, sf_dir, "raw_events"), "user_id", order_by=["event_id"]).df
    return rounded(out, "value", digits=6)


@query("prepare_forced_steps", f"""
WITH {cte("raw_events")}, d AS (SELECT DISTINCT * FROM raw_events), m AS (SELECT median(value) AS v FROM d)
SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type,
       CAST(dense_rank() OVER (ORDER BY props) - 1 AS INTEGER) AS props, coalesce(value, v) AS value, k FROM d, m
""")
def prepare_forced_steps(spark, sf_dir):
    return prepare.prepare(derived(spark, sf_dir, "raw_events"), {}, "user_id").df


@query("plan_steps", """
SELECT stage, position, step, columns, option FROM (VALUES
  ('cleaning', 0, 'drop_duplicates', '', NULL), ('cleaning', 1, 'handle_missing', 'value', 'median'),
  ('features', 0, 'encode_categorical', 'event_type,props', 'label'), ('features', 1, 'log_transform', 'value', NULL)
) AS t(stage, position, step, columns, option)
""")
def plan_steps(spark, sf_dir):
    found = profile(derived(spark, sf_dir, "raw_events"))
    asked = {"feature_steps": [
        {"step": "encode_categorical", "method": "onehot"}, {"step": "log_transform", "columns": []},
        {"step": "log_transform"}, {"step": "log_transform", "columns": ["user_id", "props"]}]}
    table = steps.steps_table(spark, steps.check_plan(asked, found, "user_id"))
    return table.withColumn("columns", F.concat_ws(",", "columns"))


# Charts ----------------------------------------------------------------------

@query("chart_top_levels", f"""
WITH {cte(DIRTY)}
SELECT coalesce(l_returnflag, 'null') AS "level", count(*) AS n FROM {DIRTY} GROUP BY ALL ORDER BY n DESC, "level" LIMIT 12
""")
def chart_top_levels(spark, sf_dir):
    return charts.top_levels(derived(spark, sf_dir, DIRTY), "l_returnflag", 12)


@query("chart_trend", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
       round(regr_avgx(l_extendedprice, l_quantity), 4) AS x_mean, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx,
       min(l_quantity) AS x_min, max(l_quantity) AS x_max,
       round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)
             * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS residual_std
FROM lineitem
""")
def chart_trend(spark, sf_dir):
    out = charts.trend(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(out, "slope", "intercept", "x_mean", "residual_std"), "sxx", digits=2)


@query("chart_trend_band", """
WITH t AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  count(*) AS n, avg(l_quantity) AS xm, regr_sxx(l_extendedprice, l_quantity) AS sxx, min(l_quantity) AS lo,
  max(l_quantity) AS hi, sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)
  * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)) AS s FROM lineitem),
g AS (SELECT t.*, lo + i / 99.0::DOUBLE * (hi - lo) AS x FROM t, range(100) AS r(i))
SELECT round(x, 4) AS x, round(a + b * x, 4) AS fitted,
  round(a + b * x - 1.959963984540054 * s * sqrt(1.0 / n + (x - xm) * (x - xm) / sxx), 4) AS lower,
  round(a + b * x + 1.959963984540054 * s * sqrt(1.0 / n + (x - xm) * (x - xm) / sxx), 4) AS upper FROM g
""")
def chart_trend_band(spark, sf_dir):
    out = charts.trend_band(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, "x", "fitted", "lower", "upper")


@query("chart_bootstrap_band", """
WITH laws AS (SELECT k, sum(exp(-1) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE)) OVER (ORDER BY k) AS below FROM range(12) AS r(k)),
factors AS (SELECT r, CAST(CAST('0x' || substr(md5('42|' || CAST(r AS STRING)), 1, 15) AS BIGINT) AS UHUGEINT) * 2 + 1 AS c FROM range(40) AS q(r)),
drawn AS (
  SELECT r, l_quantity AS x, l_extendedprice AS y,
    CAST((CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING)), 1, 15) AS BIGINT) AS UHUGEINT) * c)
      % CAST('18446744073709551616' AS UHUGEINT) // CAST('281474976710656' AS UHUGEINT) AS INTEGER) AS v
  FROM lineitem, factors),
weights AS (SELECT v, count(k) AS w FROM range(65536) AS q(v) LEFT JOIN laws ON below <= (v + 0.5::DOUBLE) / 65536 GROUP BY v),
sums AS (
  SELECT r, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
  FROM drawn JOIN weights USING (v) GROUP BY r),
lines AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sx / n AS mx, sy / n AS my FROM sums),
t AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo,
        max(l_quantity) AS hi FROM lineitem),
g AS (SELECT i, lo + i / 99.0::DOUBLE * (hi - lo) AS x, a + b * (lo + i / 99.0::DOUBLE * (hi - lo)) AS fitted FROM t, range(100) AS q(i))
SELECT round(x, 4) AS x, round(fitted, 3) AS fitted, round(quantile_cont(my + lines.b * (x - mx), 0.025), 3) AS lower,
       round(quantile_cont(my + lines.b * (x - mx), 0.975), 3) AS upper
FROM g, lines GROUP BY i, x, fitted
""")
def chart_bootstrap_band(spark, sf_dir):
    out = charts.bootstrap_band(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"], replicates=40)
    return rounded(rounded(out, "x"), "fitted", "lower", "upper", digits=3)


@query("chart_scatter_points", """
SELECT o_orderkey, o_custkey AS x, o_totalprice AS y FROM orders
""")
def chart_scatter_points(spark, sf_dir):
    return charts.scatter_points(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


def _box(table: str, level: str, value: str, k: int) -> str:
    return f"""
, top AS (SELECT coalesce(CAST({level} AS STRING), 'null') AS "level" FROM {table} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}),
r AS (SELECT coalesce(CAST({level} AS STRING), 'null') AS "level", CAST({value} AS DOUBLE) AS v FROM {table}
      WHERE {value} IS NOT NULL AND coalesce(CAST({level} AS STRING), 'null') IN (SELECT "level" FROM top)),
b AS (SELECT "level", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY 1)
SELECT r."level", round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, count(*) AS n,
  min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM r JOIN b ON r."level" = b."level" GROUP BY r."level", q1, q2, q3
"""


@query("chart_box_by_feature", "WITH dummy AS (SELECT 1)" + _box("events", "props", "value", 12))
def chart_box_by_feature(spark, sf_dir):
    return rounded(charts.box_stats(read(spark, sf_dir, "events"), "props", "value"), "q1", "median", "q3")


@query("chart_box_by_class", f"WITH {cte(DIRTY)}" + _box(DIRTY, "l_returnflag", "l_extendedprice", 8))
def chart_box_by_class(spark, sf_dir):
    out = charts.box_stats(derived(spark, sf_dir, DIRTY), "l_returnflag", "l_extendedprice", charts.CLASS_LEVELS)
    return rounded(out, "q1", "median", "q3")


@query("chart_crosstab", """
WITH a AS (SELECT event_type AS x FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
b AS (SELECT props AS y FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
c AS (SELECT event_type AS x, props AS y, count(*) AS n FROM events GROUP BY ALL)
SELECT a.x, b.y, coalesce(c.n, 0) AS n FROM a CROSS JOIN b LEFT JOIN c ON c.x = a.x AND c.y = b.y
""")
def chart_crosstab(spark, sf_dir):
    return charts.crosstab(read(spark, sf_dir, "events"), "event_type", "props")


@query("safe_names", """
SELECT doc_id, regexp_replace(source || ' / ' || lang, '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM documents
""")
def safe_names(spark, sf_dir):
    from millrace.functions.columns import safe_name
    return read(spark, sf_dir, "documents").select(
        "doc_id", safe_name(F.concat("source", F.lit(" / "), "lang")).alias("name"))


@query("quantiles_refined", "SELECT " + ", ".join(
    f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {c}_{int(p * 100)}"
    for c in ("l_extendedprice", "l_discount", "l_orderkey", "l_linenumber") for p in (0.01, 0.25, 0.5, 0.99)
) + " FROM lineitem")
def quantiles_refined(spark, sf_dir):
    """Exact quantiles by histogram refinement, as on tables of any size."""
    from millrace.functions.order_stats import quantiles
    columns, probs = ["l_extendedprice", "l_discount", "l_orderkey", "l_linenumber"], (0.01, 0.25, 0.5, 0.99)
    found = quantiles(read(spark, sf_dir, "lineitem"), columns, probs)
    row = {f"{c}_{int(p * 100)}": found[c][i] for c in columns for i, p in enumerate(probs)}
    return rounded(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row)), *row)


@query("chart_scatter_bins", """
WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / (b - a) * 50), 49) AS INTEGER) AS x_bin,
       CAST(least(floor((l_extendedprice - c) / (d - c) * 50), 49) AS INTEGER) AS y_bin, count(*) AS n
FROM lineitem, e GROUP BY 1, 2
""")
def chart_scatter_bins(spark, sf_dir):
    return charts.scatter_bins(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


HEAVY_COLUMNS = ["o_custkey", "o_totalprice"]


@query("prepare_heavy_steps", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CAST(o_custkey AS DOUBLE) * o_custkey AS o_custkey_pow2,
       o_totalprice * o_totalprice AS o_totalprice_pow2, o_custkey * o_totalprice AS o_custkey_x_o_totalprice FROM orders
""")
def prepare_heavy_steps(spark, sf_dir):
    """Powers and interactions are taken whatever the number of rows."""
    plan = {"feature_steps": [{"step": "polynomial_features", "columns": HEAVY_COLUMNS}, {"step": "interaction_features", "columns": HEAVY_COLUMNS}]}
    df = read(spark, sf_dir, "orders").select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in HEAVY_COLUMNS])
    return prepare.prepare(df, plan, "o_orderkey").df
