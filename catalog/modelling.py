from __future__ import annotations

import dataclasses
import uuid

from millrace.functions.storage import shared_dir
from millrace.operators import calibration, folds, metrics, models, report, selection
from millrace.operators.features import assemble
from millrace.operators.importance import importance, linear_importance, permutation_drops, permutation_importance
from millrace.sources import sinks
from pyspark.sql import functions as F

from .derived import cte, derived
from .registry import query, read, rounded, union

# Small models: the queries show the work, the library defaults set the size.
QUICK = models.Settings(trees=5, rounds=3, forest_depth=5, margin_iterations=5, linear_iterations=50, fourier_size=32)


def hash15(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def hash8(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


# Labels, splits and folds -----------------------------------------------------------

@query("target_codes", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders
""")
def target_codes(spark, sf_dir):
    coded, _ = selection.label_codes(read(spark, sf_dir, "orders"), "o_orderpriority")
    return coded.select("o_orderkey", "label")


SEEDED = "'42|' || CAST(o_orderkey AS STRING)"


@query("split_stratified", f"""
SELECT o_orderkey, o_orderstatus, r <= least(floor(n * 0.2::DOUBLE + 0.5), n - 1) AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash15(SEEDED)}) AS r,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
""")
def split_stratified(spark, sf_dir):
    out = folds.train_test_split(read(spark, sf_dir, "orders"), ["o_orderkey"], 0.2, "o_orderstatus")
    return out.select("o_orderkey", "o_orderstatus", "is_test")


@query("split_plain", f"""
SELECT o_orderkey, r <= ceil(n * 0.2::DOUBLE) AS is_test FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {hash15(SEEDED)}) AS r, count(*) OVER () AS n FROM orders)
""")
def split_plain(spark, sf_dir):
    return folds.train_test_split(read(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query("folds_ordered", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def folds_ordered(spark, sf_dir):
    return folds.ordered_folds(read(spark, sf_dir, "orders"), "o_orderkey", 5).select("o_orderkey", "fold")


@query("folds_stratified", """
SELECT event_id, event_type,
       CAST(ntile(5) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INTEGER) AS fold FROM events
""")
def folds_stratified(spark, sf_dir):
    out = folds.ordered_folds(read(spark, sf_dir, "events"), "event_id", 5, "event_type")
    return out.select("event_id", "event_type", "fold")


@query("folds_hashed", f"""
SELECT o_orderkey, CAST({hash8("CAST(o_orderkey AS STRING)")} % 5 AS INTEGER) AS fold FROM orders
""")
def folds_hashed(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", folds.hash_fold(["o_orderkey"]).alias("fold"))


@query("scale_in_fold", f"""
WITH f AS (SELECT event_id, value, user_id, {hash8("CAST(event_id AS STRING)")} % 5 AS fold FROM events),
s AS (SELECT avg(value) AS vm, stddev_pop(value) AS vs, avg(user_id) AS um, stddev_pop(user_id) AS us FROM f WHERE fold <> 0)
SELECT event_id, round((value - vm) / vs, 6) AS value, round((user_id - um) / us, 6) AS user_id FROM f, s
""")
def scale_in_fold(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "value", "user_id").withColumn("fold", folds.hash_fold(["event_id"]))
    stats = models.fit_scale(df.where("fold <> 0"), ["value", "user_id"])
    return rounded(models.apply_scale(df, stats).drop("fold"), "value", "user_id", digits=6)


# Linear models ------------------------------------------------------------------------

def _fitted(df, features, label, build):
    """One fit on the whole table."""
    from millrace.operators.features import assemble
    table = assemble(df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("label")), features)
    row = table.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    return build(models.TrainingFacts(row["n"], len(features), 0, row["s"])).fit(table)


TERMS = ["l_quantity", "l_discount"]
MOMENTS = """s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
  stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, corr(l_quantity, l_discount) AS r,
  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem)"""


def _terms(alpha: float) -> str:
    """Normal equations of two scaled features with a penalty, solved by hand."""
    return f"""WITH {MOMENTS}, w AS (
  SELECT *, ((n + {alpha}) * n * c1 / s1 - n * r * n * c2 / s2) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) AS w1,
            ((n + {alpha}) * n * c2 / s2 - n * r * n * c1 / s1) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) AS w2 FROM s)"""


def _term_rows(alpha: float) -> str:
    return _terms(alpha) + """
SELECT 'l_quantity' AS term, round(w1 / s1, 4) AS coefficient FROM w
UNION ALL SELECT 'l_discount', round(w2 / s2, 4) FROM w
UNION ALL SELECT 'intercept', round(my - w1 / s1 * m1 - w2 / s2 * m2, 4) FROM w
"""


def _term_table(spark, model):
    rows = list(models.linear_terms(model, TERMS).items())
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"), "coefficient")


@query("model_linear_regression", _term_rows(0.0))
def model_linear_regression(spark, sf_dir):
    model = _fitted(read(spark, sf_dir, "lineitem"), TERMS, "l_extendedprice", models.linear_regression())
    return _term_table(spark, model)


@query("model_ridge", _term_rows(5000.0))
def model_ridge(spark, sf_dir):
    model = _fitted(read(spark, sf_dir, "lineitem"), TERMS, "l_extendedprice", models.ridge(models.Settings(alpha=5000.0)))
    return _term_table(spark, model)


@query("importance_linear", _terms(0.0) + """
SELECT 'l_quantity' AS feature, round(abs(w1) / (abs(w1) + abs(w2)), 4) AS importance FROM w
UNION ALL SELECT 'l_discount', round(abs(w2) / (abs(w1) + abs(w2)), 4) FROM w
""")
def importance_linear(spark, sf_dir):
    model = _fitted(read(spark, sf_dir, "lineitem"), TERMS, "l_extendedprice", models.linear_regression())
    shares = linear_importance(model.stages[-1].coefficients.toArray())
    return rounded(spark.createDataFrame([(t, float(v)) for t, v in zip(TERMS, shares)],
                                         "feature string, importance double"), "importance")


def _cv_sql() -> str:
    """Cross-validation of a one-feature line, written out fold by fold."""
    def fold_scores(fold: str, k: int) -> str:
        return union([f"""
SELECT '{fold}' AS kind, sqrt(avg(power(y - (a + b * x), 2))) AS rmse, 1 - avg(power(y - (a + b * x), 2)) / var_pop(y) AS r2
FROM train, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train WHERE {fold} <> {i}) WHERE {fold} = {i}"""
                      for i in range(k)])
    return f"""
WITH h AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, {hash8(SEEDED)} % 5 AS fold, {hash8(SEEDED)} % 3 AS train_fold,
  row_number() OVER (ORDER BY {hash15(SEEDED)}) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM orders),
train AS (SELECT * FROM h WHERE NOT is_test),
s AS ({fold_scores("fold", 5)} UNION ALL {fold_scores("train_fold", 3)}),
held AS (SELECT sqrt(avg(power(y - (a + b * x), 2))) AS rmse FROM h,
  (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train) WHERE is_test)
SELECT 'LinearRegression' AS model_name, round(avg(rmse) FILTER (WHERE kind = 'fold'), 2) AS score,
  round(avg(rmse) FILTER (WHERE kind = 'train_fold'), 2) AS train_score,
  round(avg(r2) FILTER (WHERE kind = 'fold'), 4) AS r2_score,
  round(avg(r2) FILTER (WHERE kind = 'train_fold'), 4) AS r2_train_score,
  round((SELECT rmse FROM held), 2) AS holdout_score FROM s
"""


def _linear_cv(spark, sf_dir):
    return selection.train_and_evaluate(
        derived(spark, sf_dir, "scored_orders"), "o_totalprice", "regression", "rmse", keys=["o_orderkey"],
        builders={"LinearRegression": models.linear_regression()})


@query("cross_validation", _cv_sql())
def cross_validation(spark, sf_dir):
    """Split, five folds, three training folds, r2 from the same predictions, held-out score."""
    board = _linear_cv(spark, sf_dir).leaderboard.drop("params")
    return rounded(board, "score", "train_score", "holdout_score", digits=2)


# Metrics -----------------------------------------------------------------------------

def _regression_metric(name: str, sql: str):
    @query(f"metric_{name}", f"WITH {cte('predictions')} SELECT round({sql}, 6) AS {name} FROM predictions")
    def run(spark, sf_dir):
        scores = metrics.regression_scores(derived(spark, sf_dir, "predictions"), "y", "p")
        return rounded(scores.select(name), name, digits=6)


_regression_metric("rmse", "sqrt(avg((y - p) * (y - p)))")
_regression_metric("mae", "avg(abs(y - p))")
_regression_metric("r2", "1 - avg((y - p) * (y - p)) / var_pop(y)")
_regression_metric("mape", "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))")

PER_CLASS = """c AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS g,
  count(*) FILTER (WHERE y = k AND p = k) AS h FROM {t}, (SELECT DISTINCT y AS k FROM {t} UNION SELECT DISTINCT p FROM {t})
  GROUP BY k)"""
CLASS_SQL = {
    "accuracy": "sum(h) / sum(s)",
    "f1": "sum(s * CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END) / sum(s)",
    "precision": "sum(s * CASE WHEN g > 0 THEN h / g ELSE 0 END) / sum(s)",
    "recall": "sum(s * CASE WHEN s > 0 THEN h / s ELSE 0 END) / sum(s)",
}


def _class_metric(name: str, table: str, suffix: str):
    @query(f"metric_{name}{suffix}",
           f"WITH {cte(table)}, {PER_CLASS.format(t=table)} SELECT round({CLASS_SQL[name]}, 6) AS {name} FROM c")
    def run(spark, sf_dir):
        scores = metrics.classification_scores(derived(spark, sf_dir, table), "y", "p")
        return rounded(scores.select(name), name, digits=6)


for _name in CLASS_SQL:
    _class_metric(_name, "class_predictions", "")
    _class_metric(_name, "multi_predictions", "_multiclass")


@query("metric_confusion", f"""
WITH {cte("multi_predictions")} SELECT y AS label, p AS prediction, count(*) AS n FROM multi_predictions GROUP BY y, p
""")
def metric_confusion(spark, sf_dir):
    return metrics.confusion(derived(spark, sf_dir, "multi_predictions"), "y", "p")


def _auc(table: str, positive: str, score: str) -> str:
    return (f"SELECT sum(CASE WHEN {positive} THEN rk END) AS rs, count(*) FILTER (WHERE {positive})::DOUBLE AS np, "
            f"count(*) FILTER (WHERE NOT ({positive}))::DOUBLE AS nn FROM (SELECT *, rank() OVER (ORDER BY {score}) + "
            f"(count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {table})")


@query("metric_roc_auc", f"""
WITH {cte("class_predictions")}
SELECT round((rs - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM ({_auc("class_predictions", "y = 1", "score")})
""")
def metric_roc_auc(spark, sf_dir):
    out = metrics.roc_auc(derived(spark, sf_dir, "class_predictions"), "y", "score")
    return rounded(out, "roc_auc", digits=6)


@query("metric_roc_auc_ovr", f"""
WITH {cte("multi_predictions")}
SELECT round(sum(np * (rs - np * (np + 1) / 2) / (np * nn)) / sum(np), 6) AS roc_auc
FROM ({union([_auc("multi_predictions", f"y = {i}", f"s{i}") for i in range(4)])})
""")
def metric_roc_auc_ovr(spark, sf_dir):
    df = derived(spark, sf_dir, "multi_predictions").withColumn(
        "s", F.array(*[F.col(f"s{i}").cast("double") for i in range(4)]))
    return rounded(metrics.roc_auc_ovr(df, "y", "s", 4), "roc_auc", digits=6)


# Ranking ------------------------------------------------------------------------------

RULES = {"flat": "y * 0 + 50000", "line": "p", "half": "y / 2", "near": "y + 10"}


@query("leaderboard", f"WITH {cte('predictions')}, s AS (" + union([
    f"SELECT '{n}' AS model_name, round(avg(abs(y - ({e}))), 4) AS score FROM predictions" for n, e in RULES.items()
]) + ") SELECT model_name, score, row_number() OVER (ORDER BY score, model_name) AS place FROM s")
def leaderboard(spark, sf_dir):
    """Fixed rules as models, ranked by an error metric (smaller is better)."""
    df = derived(spark, sf_dir, "predictions")
    long = df.selectExpr("y", f"inline(array({', '.join(f'struct({chr(39)}{n}{chr(39)} AS model_name, double({e}) AS q)' for n, e in RULES.items())}))")
    scores = metrics.regression_scores(long, "y", "q", ["model_name"])
    board = rounded(scores.selectExpr("model_name", "mae AS score"), "score")
    names = [r["model_name"] for r in report.ranked(board, "mae").collect()]
    places = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "model_name string, place bigint")
    return board.join(F.broadcast(places), "model_name")


def _rings(repeats: int) -> str:
    key = "CAST(event_id AS STRING)"
    return union([f"""
SELECT {r} AS r, event_id, y, x0, x1, coalesce(lead(x0) OVER w, first_value(x0) OVER w) AS n0,
       coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS n1
FROM e WINDOW w AS (ORDER BY {hash15(f"'{42 + r}|' || {key}")}, event_id)""" for r in range(repeats)])


PERMUTED = f"""
WITH e AS (SELECT event_id, value AS x0, CAST(user_id AS DOUBLE) AS x1, CAST(value + user_id / 10.0::DOUBLE > 35 AS INTEGER) AS y
           FROM events), rings AS ({_rings(5)}),
base AS (SELECT avg((y = CAST(x0 + x1 / 10 > 30 AS INTEGER))::INTEGER) AS s FROM e),
d AS (SELECT (SELECT s FROM base) - avg((y = CAST(n0 + x1 / 10 > 30 AS INTEGER))::INTEGER) AS d0,
             (SELECT s FROM base) - avg((y = CAST(x0 + n1 / 10 > 30 AS INTEGER))::INTEGER) AS d1 FROM rings)
"""


def _rule_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "array(value, CAST(user_id AS DOUBLE)) AS x", "CAST(value + user_id / 10D > 35 AS INT) AS label")


def _rule(df):
    return df.withColumn("prediction", F.expr("CAST(x[0] + x[1] / 10 > 30 AS INT)"))


@query("permutation_drops", PERMUTED + """
SELECT 'value' AS feature, round(d0, 6) AS drop FROM d UNION ALL SELECT 'user_id', round(d1, 6) FROM d
""")
def permutation_drop_rows(spark, sf_dir):
    out = permutation_drops(_rule_rows(spark, sf_dir), ["value", "user_id"], _rule, ["event_id"], "classification")
    return rounded(out, "drop", digits=6)


@query("permutation_importance", PERMUTED + """
SELECT 'value' AS feature, round(greatest(d0, 0) / (greatest(d0, 0) + greatest(d1, 0)), 4) AS importance FROM d
UNION ALL SELECT 'user_id', round(greatest(d1, 0) / (greatest(d0, 0) + greatest(d1, 0)), 4) FROM d
""")
def permutation_shares(spark, sf_dir):
    return permutation_importance(_rule_rows(spark, sf_dir), ["value", "user_id"], _rule, ["event_id"], "classification")


@query("report_top_importance", PERMUTED + """
SELECT 'value' AS feature, round(greatest(d0, 0) / (greatest(d0, 0) + greatest(d1, 0)), 4) AS importance FROM d
WHERE d0 > d1
UNION ALL SELECT 'user_id', round(greatest(d1, 0) / (greatest(d0, 0) + greatest(d1, 0)), 4) FROM d WHERE d1 >= d0
""")
def top_importance(spark, sf_dir):
    return report.top_importance(permutation_shares(spark, sf_dir), 1)


# Trained models (no SQL form: rows only) --------------------------------------------------

def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "value", "user_id", "hour(ts) AS hour",
        "CASE WHEN value > 60 THEN 'high' WHEN value > 15 + user_id / 10 THEN 'mid' ELSE 'low' END AS level")


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "month(o_orderdate) AS month", "year(o_orderdate) AS year",
        "o_totalprice * (1 + month(o_orderdate)) + o_custkey AS amount", "o_totalprice")


def _held_out(spark, df, target, task, metric, key, name, build):
    """Fit one candidate on the training part and score the held-out rows."""
    table, names, n_classes = selection.modelling_table(df, target, task, [key])
    trainer = selection._Trainer(table, task, metric, len(names), n_classes, 5)
    model = trainer.fit(build)
    predicted = selection._predict(model, trainer.test, task)
    score = metrics.regression_scores if task == "regression" else metrics.classification_scores
    return score(predicted).withColumn("model_name", F.lit(name)), model, trainer, names


def _classifier(key: str, name: str, build):
    @query(f"model_{key}")
    def run(spark, sf_dir):
        return _held_out(spark, _events(spark, sf_dir), "level", "classification", "f1", "event_id", name, build)[0]


def _regressor(key: str, name: str, build):
    @query(f"model_{key}")
    def run(spark, sf_dir):
        return _held_out(spark, _lines(spark, sf_dir), "amount", "regression", "r2", "o_orderkey", name, build)[0]


_classifier("logistic_regression", "LogisticRegression", models.logistic_regression(QUICK))
_classifier("forest_classifier", "RandomForestClassifier", models.forest_classifier(QUICK))
_classifier("boosted_classifier", "GradientBoostingClassifier", models.boosted_classifier(QUICK))
_classifier("svc", "SVC", models.margin_classifier(QUICK))
_regressor("forest_regressor", "RandomForestRegressor", models.forest_regressor(QUICK))
_regressor("boosted_regressor", "GradientBoostingRegressor", models.boosted_regressor(QUICK))
_regressor("svr", "SVR", models.margin_regressor(QUICK))


@query("importance_tree")
def importance_tree(spark, sf_dir):
    _, model, trainer, names = _held_out(
        spark, _lines(spark, sf_dir), "amount", "regression", "r2", "o_orderkey", "forest", models.forest_regressor(QUICK))
    return importance(model, trainer.train, names, ["o_orderkey"], "regression")


@query("importance_svr")
def importance_svr(spark, sf_dir):
    """No native importances, so permutation over the training rows."""
    _, model, trainer, names = _held_out(
        spark, _lines(spark, sf_dir), "amount", "regression", "r2", "o_orderkey", "svr", models.margin_regressor(QUICK))
    return importance(model, trainer.train, names, ["o_orderkey"], "regression")


@query("save_best_model", "SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_differ FROM orders")
def save_best_model(spark, sf_dir):
    """Save a fitted pipeline, load it, and count rows whose predictions differ (none)."""
    _, model, trainer, _ = _held_out(
        spark, _lines(spark, sf_dir), "amount", "regression", "r2", "o_orderkey", "svr", models.margin_regressor(QUICK))
    folder = f"{shared_dir(spark).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    loaded = sinks.load_best(sinks.save_best(model, "Support vectors", folder))
    before = model.transform(trainer.test).select("o_orderkey", F.col("prediction").alias("a"))
    after = loaded.transform(trainer.test).select("o_orderkey", F.col("prediction").alias("b"))
    return before.join(after, "o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("n_differ"))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    chosen = {"LinearRegression": models.linear_regression(QUICK), "Ridge": models.ridge(QUICK),
              "RandomForestRegressor": models.forest_regressor(QUICK)}
    found = selection.train_and_evaluate(_lines(spark, sf_dir), "amount", "regression", "mae", keys=["o_orderkey"],
                                         builders=chosen, parallelism=3)
    return report.model_comparison(found.leaderboard, "regression", "mae")


@query("model_parameters")
def model_parameters(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return selection.params_table(_fitted(df, TERMS, "l_extendedprice", models.ridge()), df)


@query("folds_stratified_hash", f"""
SELECT o_orderkey, o_orderstatus, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY {hash15(SEEDED)}) - 1 AS INTEGER) AS fold FROM orders
""")
def folds_stratified_hash(spark, sf_dir):
    out = folds.stratified_folds(read(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus", 5, 42)
    return out.select("o_orderkey", "o_orderstatus", "fold")


SIGMOID_SCORES = [
    ("low", "-l_extendedprice / 20000", "l_quantity < 17"), ("middle", "-abs(l_extendedprice / 20000 - 1.5)", "l_quantity BETWEEN 17 AND 34"),
    ("high", "l_extendedprice / 20000 + l_discount", "l_quantity > 34")]


@query("svc_probabilities", f"""
WITH RECURSIVE s AS ({union([f"SELECT '{c}' AS class, CAST({f} AS DOUBLE) AS f, {hit} AS hit FROM lineitem" for c, f, hit in SIGMOID_SCORES])}),
c AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM s GROUP BY class),
newton(k, class, a, b) AS (
  SELECT 0, class, CAST(0 AS DOUBLE), ln((h + 1) / (n - h + 1)) FROM c
  UNION ALL
  SELECT k + 1, class, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT k, class, a, b, sum((p - t) * f) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * f * f) AS haa, sum(p * (1 - p) * f) AS hab,
               sum(p * (1 - p)) AS hbb
        FROM (SELECT k, class, a, b, f, 1 / (1 + exp(-(a * f + b))) AS p, CASE WHEN hit THEN (h + 1) / (h + 2) ELSE 1 / (n - h + 2) END AS t
              FROM newton JOIN s USING (class) JOIN c USING (class) WHERE k < 20)
        GROUP BY k, class, a, b))
SELECT class, n, h AS hits, round(a, 5) AS slope, round(b, 5) AS intercept FROM newton JOIN c USING (class) WHERE k = 20
""")
def svc_probabilities(spark, sf_dir):
    """The sigmoids that turn scores of three classes into probabilities, fitted on given scores."""
    lines = read(spark, sf_dir, "lineitem")
    scores = [lines.selectExpr(f"'{c}' AS class", f"CAST({f} AS DOUBLE) AS score", f"{hit} AS hit") for c, f, hit in SIGMOID_SCORES]
    scores = scores[0].unionAll(scores[1]).unionAll(scores[2])
    found = spark.createDataFrame([(c, *v) for c, v in calibration.fit_sigmoids(scores).items()], "class string, slope double, intercept double")
    counts = scores.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return rounded(counts.join(found, "class"), "slope", "intercept", digits=5)


@query("model_svc_probabilities")
def model_svc_probabilities(spark, sf_dir):
    """Held-out area under the curve of the margin classifier's probabilities, learned from out-of-fold scores."""
    settings = dataclasses.replace(QUICK, margin_folds=3)
    table, names, n_classes = selection.modelling_table(_events(spark, sf_dir), "level", "classification", ["event_id"])
    trainer = selection._Trainer(table, "classification", "roc_auc", len(names), n_classes, 5)
    predicted = selection._predict(trainer.fit(models.margin_classifier(settings)), trainer.test, "classification")
    return metrics.roc_auc_ovr(predicted, "label", "scores", n_classes)


@query("model_linear_collinear", """
WITH t AS (SELECT l_quantity AS x, l_discount * 100 AS z, l_quantity + l_discount * 100 AS v, l_extendedprice AS y FROM lineitem),
m AS (SELECT stddev_samp(x) AS sx, stddev_samp(z) AS sz, stddev_samp(v) AS sv, var_samp(x) AS xx, var_samp(z) AS zz, covar_samp(x, z) AS xz,
             covar_samp(x, y) AS xy, covar_samp(z, y) AS zy FROM t),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) * sx AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) * sz AS b2 FROM m),
n AS (SELECT *, (sx * b1 + sz * b2) / (sx * sx + sz * sz + sv * sv) AS along FROM b)
SELECT round(b1 - sx * along, 4) AS x, round(b2 - sz * along, 4) AS z, round(sv * along, 4) AS v FROM n
""")
def model_linear_collinear(spark, sf_dir):
    """Scaled coefficients of minimum norm where one feature is the sum of two others."""
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity AS x", "l_discount * 100 AS z", "l_quantity + l_discount * 100 AS v", "l_extendedprice AS label")
    table = assemble(rows, ["x", "z", "v"])
    model = models.linear_regression(models.Settings(minimum_norm=True))(models.TrainingFacts(table.count(), 3)).fit(table)
    found = spark.createDataFrame([tuple(map(float, model.stages[-1].coefficients))], "x double, z double, v double")
    return rounded(found, "x", "z", "v")
