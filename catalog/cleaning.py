from __future__ import annotations

from millrace.operators import clean
from millrace.plans import prepare

from .derived import cte, derived
from .registry import query, read, rounded

DIRTY = "dirty_lineitem"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)
MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def fence(column: str, table: str = DIRTY) -> str:
    """One-row CTE body with the outlier bounds of a column."""
    return (f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT "
            f"quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {table})")


@query("impute_median", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, coalesce(l_quantity, (SELECT median(l_quantity) FROM {DIRTY})) AS l_quantity FROM {DIRTY}
""")
def impute_median(spark, sf_dir):
    return clean.impute(derived(spark, sf_dir, DIRTY), ["l_quantity", "l_tax"]).select(*KEYS, "l_quantity")


@query("impute_mean", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {DIRTY})), 6) AS l_quantity FROM {DIRTY}
""")
def impute_mean(spark, sf_dir):
    out = clean.impute(derived(spark, sf_dir, DIRTY), ["l_quantity"], "mean").select(*KEYS, "l_quantity")
    return rounded(out, "l_quantity", digits=6)


@query("impute_mode", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, coalesce(l_quantity, {MODE.format(c="l_quantity", t=DIRTY)}) AS l_quantity FROM {DIRTY}
""")
def impute_mode(spark, sf_dir):
    return clean.impute(derived(spark, sf_dir, DIRTY), ["l_quantity"], "mode").select(*KEYS, "l_quantity")


@query("impute_text", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, coalesce(l_returnflag, {MODE.format(c="l_returnflag", t=DIRTY)}) AS l_returnflag FROM {DIRTY}
""")
def impute_text(spark, sf_dir):
    return clean.impute(derived(spark, sf_dir, DIRTY), ["l_returnflag"], "median").select(*KEYS, "l_returnflag")


@query("impute_text_unknown", f"""
WITH {cte("text_part")} SELECT p_partkey, coalesce(z, 'Unknown') AS z FROM text_part
""")
def impute_text_unknown(spark, sf_dir):
    return clean.impute(derived(spark, sf_dir, "text_part"), ["z"]).select("p_partkey", "z")


@query("drop_null_rows", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, l_quantity, l_returnflag FROM {DIRTY} WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL
""")
def drop_null_rows(spark, sf_dir):
    out = clean.impute(derived(spark, sf_dir, DIRTY), ["l_quantity", "l_returnflag", "l_tax"], "drop_rows")
    return out.select(*KEYS, "l_quantity", "l_returnflag")


@query("drop_null_columns", f"""
WITH {cte(DIRTY)} SELECT {KEY_SQL}, l_extendedprice, l_discount, l_tax, l_linestatus FROM {DIRTY}
""")
def drop_null_columns(spark, sf_dir):
    df = derived(spark, sf_dir, DIRTY)
    return clean.impute(df, df.columns, "drop_cols")


@query("outlier_clip", f"""
WITH {cte(DIRTY)}, p AS ({fence("l_extendedprice")}), q AS ({fence("l_quantity")})
SELECT {KEY_SQL},
  round(CASE WHEN l_extendedprice IS NOT NULL THEN greatest(least(l_extendedprice, p.hi), p.lo) END, 4) AS l_extendedprice,
  round(CASE WHEN l_quantity IS NOT NULL THEN greatest(least(l_quantity, q.hi), q.lo) END, 4) AS l_quantity
FROM {DIRTY}, p, q
""")
def outlier_clip(spark, sf_dir):
    out = clean.trim_outliers(derived(spark, sf_dir, DIRTY), ["l_extendedprice", "l_quantity"], "clip")
    return rounded(out.select(*KEYS, "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")


@query("outlier_zscore", f"""
WITH {cte(DIRTY)}, s AS (SELECT avg(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS ps,
                                avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs FROM {DIRTY})
SELECT {KEY_SQL}, l_extendedprice, l_quantity FROM {DIRTY}, s
WHERE abs((l_extendedprice - pm) / (ps + 1e-9)) <= 3 AND abs((l_quantity - qm) / (qs + 1e-9)) <= 3
""")
def outlier_zscore(spark, sf_dir):
    out = clean.trim_outliers(derived(spark, sf_dir, DIRTY), ["l_extendedprice", "l_quantity"], "zscore")
    return out.select(*KEYS, "l_extendedprice", "l_quantity")


@query("outlier_iqr", f"""
WITH {cte(DIRTY)}, p AS ({fence("l_extendedprice")}), q AS ({fence("l_quantity")})
SELECT {KEY_SQL}, l_extendedprice, l_quantity FROM {DIRTY}, p, q
WHERE l_extendedprice BETWEEN p.lo AND p.hi AND l_quantity BETWEEN q.lo AND q.hi
""")
def outlier_iqr(spark, sf_dir):
    out = clean.trim_outliers(derived(spark, sf_dir, DIRTY), ["l_extendedprice", "l_quantity"])
    return out.select(*KEYS, "l_extendedprice", "l_quantity")


@query("drop_listed_columns", f"""
WITH {cte("text_part")} SELECT p_partkey, p_brand, p_type, p_size_text, p_retailprice FROM text_part
""")
def drop_listed_columns(spark, sf_dir):
    return clean.drop_columns(derived(spark, sf_dir, "text_part"), ["k", "z", "not there"])


@query("to_numeric", f"""
WITH {cte("text_part")}
SELECT p_partkey, CASE WHEN p_size_text = 'n/a' THEN NULL ELSE CAST(p_size_text AS DOUBLE) END AS p_size_text,
       CAST(NULL AS DOUBLE) AS p_brand FROM text_part
""")
def to_numeric(spark, sf_dir):
    out = clean.convert(derived(spark, sf_dir, "text_part"), ["p_size_text", "p_brand"], "numeric")
    return out.select("p_partkey", "p_size_text", "p_brand")


@query("to_datetime", f"""
WITH {cte("dated_orders")} SELECT o_orderkey, CAST(try_cast(o_date AS TIMESTAMP) AS STRING) AS o_date FROM dated_orders
""")
def to_datetime(spark, sf_dir):
    out = clean.convert(derived(spark, sf_dir, "dated_orders"), ["o_date"], "datetime")
    return out.selectExpr("o_orderkey", "CAST(o_date AS STRING) AS o_date")


@query("to_string", f"""
WITH {cte(DIRTY)} SELECT {KEY_SQL}, CAST(CAST(l_quantity AS INTEGER) AS STRING) AS q FROM {DIRTY}
""")
def to_string(spark, sf_dir):
    df = derived(spark, sf_dir, DIRTY).selectExpr(*KEYS, "CAST(l_quantity AS INT) AS q")
    return clean.convert(df, ["q"], "string")


@query("drop_duplicate_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_duplicate_rows(spark, sf_dir):
    return clean.drop_duplicates(derived(spark, sf_dir, "dup_orders"))


@query("drop_null_target", f"WITH {cte(DIRTY)} SELECT {KEY_SQL}, l_quantity FROM {DIRTY} WHERE l_quantity IS NOT NULL")
def drop_null_target(spark, sf_dir):
    return clean.drop_null_target(derived(spark, sf_dir, DIRTY), "l_quantity").select(*KEYS, "l_quantity")


@query("fill_remaining", f"""
WITH {cte(DIRTY)}
SELECT {KEY_SQL}, coalesce(l_quantity, (SELECT median(l_quantity) FROM {DIRTY})) AS l_quantity,
       coalesce(l_returnflag, {MODE.format(c="l_returnflag", t=DIRTY)}) AS l_returnflag FROM {DIRTY}
""")
def fill_remaining(spark, sf_dir):
    return clean.fill_remaining(derived(spark, sf_dir, DIRTY), "l_tax").select(*KEYS, "l_quantity", "l_returnflag")


@query("cleaning_plan", f"""
WITH {cte(DIRTY)}, f AS ({fence("l_extendedprice")}),
kept AS (SELECT * FROM {DIRTY}, f WHERE l_extendedprice BETWEEN lo AND hi)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_returnflag_mode AS l_returnflag,
       l_quantity FROM (
  SELECT kept.*, coalesce(l_returnflag, {MODE.format(c="l_returnflag", t="kept")}) AS l_returnflag_mode FROM kept
) WHERE l_quantity IS NOT NULL
""")
def cleaning_plan(spark, sf_dir):
    steps = [
        {"step": "remove_outliers", "columns": ["l_extendedprice"], "method": "iqr"},
        {"step": "polish", "columns": ["l_tax"]},
        {"step": "handle_missing", "columns": ["l_returnflag", "l_quantity"], "method": "mode"},
        {"step": "drop_constants", "columns": ["l_tax", "l_linestatus"]},
    ]
    return prepare.run_cleaning(derived(spark, sf_dir, DIRTY), steps, "l_quantity").df


@query("drop_few_duplicate_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_few_duplicate_rows(spark, sf_dir):
    """Only rows whose hash repeats are shuffled whole."""
    return clean.drop_duplicates(derived(spark, sf_dir, "dup_orders"), few=True)
