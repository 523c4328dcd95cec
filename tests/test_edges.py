"""Edge cases of single operators on small hand-made tables."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import null_nan
from millrace.functions.running import running_sum
from millrace.functions.value_counts import cardinality, judged_cardinality, modes
from millrace.operators import charts, clean, features, folds, metrics, profile, report, validate
from millrace.operators import importance as importance_module
from millrace.operators.importance import permuted_rows
from millrace.plans import prepare
from millrace.sources import sinks, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nan_becomes_null(spark):
    df = null_nan(spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string"))
    assert rows(df) == [(None, "a"), (1.0, None)]


def test_number_texts(spark):
    good = ["1", " 2 ", "-3.5", "+4", ".5", "5.", "1e3", "1E-2", "inf", "Infinity", "-Inf"]
    bad = ["1d", "1.5f", "1_000", "", " ", "abc", "1,000", "0x10", "--1", "1e", "."]
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    got = [r[0] for r in clean.convert(df, ["s"], "numeric").collect()]
    assert got[:9] == [1.0, 2.0, -3.5, 4.0, 0.5, 5.0, 1000.0, 0.01, math.inf]
    assert got[len(good):] == [None] * len(bad)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, c int")
    assert [r["n_unique"] for r in cardinality(df).collect()] == [0, 0, 0]
    assert profile.duplicate_rows(df).first()[0] == 0
    assert clean.fit_fill(df, df.columns) == {}
    assert rows(clean.trim_outliers(df, ["a", "c"])) == []
    assert features.fit_dates(df, ["b"]) == {}
    assert profile.profile(df).n_rows == 0
    assert validate.validate(df, "c").severity == "warning"


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 1, "x")] * 3, "z string, k int, s string")
    assert {r["column"] for r in profile.constant_columns(df).collect()} == {"z", "k", "s"}
    assert clean.fit_fill(df, ["z"]) == {"z": "Unknown"}
    assert not profile.skew(df).first()["is_skewed"]
    assert rows(profile.target_correlation(df.withColumn("y", F.lit(1.0)), "y")) == [("k", None)]


def test_skew_needs_three_values(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    assert profile.skew(df).first()["skew"] is None


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 2), ("a", 1), (None, None)], "s string, n int")
    assert modes(df, ["s", "n"]) == {"s": "a", "n": 1}


def test_median_fill_widens_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    out = clean.impute(df, ["n"])
    assert out.dtypes == [("n", "double")] and rows(out) == [(1.0,), (2.0,), (1.5,)]


def test_unknown_method_is_median(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "n double")
    assert rows(clean.impute(df, ["n"], "iqr"))[2] == (2.0,)


def test_clip_keeps_nulls_and_iqr_drops_them(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(1000.0,), (None,)], "x double")
    clipped = [r[0] for r in clean.trim_outliers(df, ["x"], "clip").collect()]
    assert clipped[-1] is None and clipped[-2] < 1000
    assert clean.trim_outliers(df, ["x"], "iqr").count() == 10
    assert clean.trim_outliers(df, ["x"], "zscore").where("x IS NULL").count() == 0


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, None), (1, None)], "a int, b int")
    assert profile.duplicate_rows(df).first()[0] == 3
    assert clean.drop_duplicates(df).count() == 2
    assert clean.drop_duplicates(df, few=True).count() == 2
    assert clean.drop_duplicates(df, few=True, broadcast_hashes=1).count() == 2


def test_unseen_levels_get_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "code string")
    codes = features.fit_codes(train, ["code"])
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "code string")
    assert rows(features.apply_codes(new, codes)) == [(0,), (-1,), (-1,)]


@pytest.mark.parametrize("limit", [1, 100])
def test_codes_follow_value_order(spark, limit):
    df = spark.createDataFrame([(v, f) for v, f in [("z", 2.5), ("ä", -1.0), ("B", 10.0), ("a", None), (None, 2.5)]],
                               "level string, f double")
    out = features.label_encode(df, ["level", "f"], broadcast_levels=limit).collect()
    assert sorted((r["level"], r["f"]) for r in out) == sorted([(2, 1), (3, 0), (0, 2), (1, -1), (-1, 1)])


def test_flags_and_dates_encode(spark):
    df = spark.createDataFrame([(True, "2020-01-02"), (False, "2019-05-06"), (None, "2021-01-01")], "b boolean, d string")
    out = features.label_encode(df.withColumn("d", F.to_date("d")), ["b", "d"])
    assert rows(out) == [(1, 1), (0, 0), (-1, 2)]


def test_onehot_refuses_instead_of_cutting(spark):
    df = spark.range(20).withColumn("s", F.col("id").cast("string"))
    with pytest.raises(ValueError):
        features.fit_levels(df, ["s"], max_levels=5)


@pytest.mark.parametrize("name,expected", [("sex", True), ("Sex_", True), ("S-E-X", True), ("sexes", False)])
def test_sex_names(name, expected):
    assert features.is_sex_name(name) is expected


def test_log_skips_negative(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 5.0)], "a double, b double")
    out = rows(features.log_transform(df, ["a", "b"]))
    assert out[0] == (0.0, -1.0) and out[1][0] == pytest.approx(math.log(2)) and out[1][1] == 5.0


def test_products_of_large_integers(spark):
    df = spark.createDataFrame([(2**62, 2**62)], "a bigint, b bigint")
    assert rows(features.interactions(df, ["a", "b"]))[0][2] == 2.0**124
    assert rows(features.powers(df, ["a"]))[0][2] == 2.0**124


def test_hour_part_rule(spark):
    midnight = spark.createDataFrame([("2020-01-01",), ("2020-02-03",)], "d string")
    assert "d_hour" not in features.date_parts(midnight, ["d"]).columns
    with_bad = midnight.union(spark.createDataFrame([("bad",)], "d string"))
    assert "d_hour" in features.date_parts(with_bad, ["d"]).columns
    assert features.date_parts(spark.createDataFrame([(5,)], "d int"), ["d"]).columns == ["d"]


def test_titles(spark):
    names = ["Braund, Mr. Owen", "Heikkinen, Miss. Laina", "Uruchurtu, Don. Manuel", "Sagesser, Mlle. Emma", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in features.name_titles(df, ["name"]).collect()] == [1, 0, 2, 0, 2]
    plain = spark.createDataFrame([("a",), ("b, Mr. c",)], "name string")
    assert features.name_titles(plain, ["name"]).columns == ["name"]


def test_family_needs_both_counts(spark):
    df = spark.createDataFrame([(0, 0), (1, None), (2, 1)], "SibSp int, num_parents int")
    assert rows(features.family_size(df).select("FamilySize", "IsAlone")) == [(1, 1), (None, 0), (4, 0)]
    assert features.family_size(df, "SibSp").columns == df.columns


def test_target_rules(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id int, kind string, price double")
    assert validate.resolve_target(df, "kind") == "kind"
    assert validate.resolve_target(df, None, "predict the KIND of thing") == "kind"
    assert validate.resolve_target(df, "nope") == "price"
    assert validate.infer_task(df, "kind") == "classification"
    assert metrics.check_metric("regression", "f1") == "r2"
    assert metrics.check_metric("classification", None) == "accuracy"


def test_missing_target_is_an_error(spark):
    report_ = validate.validate(spark.createDataFrame([(1,), (1,)], "a int"), "b")
    assert report_.severity == "error"


def test_order_falls_over_partition_ends(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 2 AS up", "-id AS down",
                                               "CASE WHEN id = 2500 THEN 0 ELSE id END AS dent",
                                               "CASE WHEN id % 3 = 0 THEN id END AS gaps").repartition(7)
    assert validate.order_falls(df, ["up", "down", "dent", "gaps"], ["id"]) == {
        "up": 0, "down": 4999, "dent": 1, "gaps": 0}
    assert validate.id_columns(df, order_by=["id"]) == ["id", "up"]
    assert validate.id_columns(df) == []


def test_single_member_class_stays_in_training(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(99, "b")], "id int, y string")
    out = folds.train_test_split(df, ["id"], 0.2, "y")
    assert out.where("y = 'b' AND is_test").count() == 0 and out.where("is_test").count() == 2


def test_folds_partition_the_rows(spark):
    df = spark.range(103)
    sizes = {r["fold"]: r["count"] for r in folds.ordered_folds(df, "id", 5).groupBy("fold").count().collect()}
    assert sizes == {0: 21, 1: 21, 2: 21, 3: 20, 4: 20}


def test_running_sum_matches_a_plain_sum(spark):
    df = spark.createDataFrame([("a" if i % 3 else "hot", float(i % 50), i) for i in range(500)], "g string, o double, v int")
    grouped = df.groupBy("g", "o").agg(F.sum("v").alias("v"))
    got = {(r["g"], r["o"]): r["before_v"] for r in running_sum(grouped, ["o"], ["v"], ["g"]).collect()}
    data = [tuple(r) for r in grouped.collect()]
    assert got == {(g, o): sum(v for h, p, v in data if h == g and p < o) for g, o, _ in data}


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] is None


def test_r2_of_constant_target_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "label double, prediction double")
    assert metrics.regression_scores(df).first()["r2"] is None


def test_ring_partitions_are_counted_by_rows(spark, monkeypatch):
    monkeypatch.setattr(importance_module, "RING_ROWS", 64)
    df = spark.range(1000).selectExpr("id", "array(cast(id as double)) AS x")
    out = permuted_rows(df, "x", ["id"], 2, 42)
    assert out.rdd.getNumPartitions() == 2 * 16  # few bytes in few tasks would score all rows there
    step = {(r["repeat"], r["x"][0]): r["_next"][0] for r in out.collect()}
    for r in range(2):
        at, seen = 0.0, set()
        while at not in seen:
            seen.add(at)
            at = step[r, at]
        assert len(seen) == 1000


def test_permuted_rows_are_a_permutation(spark):
    df = spark.range(1000).selectExpr("id", "array(double(id)) AS x")
    out = permuted_rows(df.repartition(7), "x", ["id"], 3, 42)
    for r in range(3):
        mine = [row["_next"][0] for row in out.where(f"repeat = {r}").collect()]
        assert sorted(mine) == [float(i) for i in range(1000)]
        ring = {row["id"]: int(row["_next"][0]) for row in out.where(f"repeat = {r}").collect()}
        at, seen = 0, 0
        while seen < 1000 and (at != 0 or seen == 0):
            at, seen = ring[at], seen + 1
        assert seen == 1000  # one ring of all rows


def test_chart_choice_and_null_level(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x")], "n int, s string, t string")
    assert charts.pick_charts(df, "n") == [("s", "box"), ("t", "box")]
    assert charts.pick_charts(df, "s") == [("n", "box_by_target"), ("t", "crosstab")]
    assert rows(charts.top_levels(df, "t", 5)) == [("x", 2), ("null", 1)]
    made = charts.chart_data(df, "s", ["n"])
    assert set(made) == {"n_vs_s", "t_vs_s"} and made["t_vs_s"].agg(F.sum("n")).first()[0] == 3


def test_ranking_directions(spark):
    board = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9)], "model_name string, score double")
    assert [r[0] for r in report.ranked(board, "r2").collect()] == ["d", "a", "b", "c"]
    assert [r[0] for r in report.ranked(board, "rmse").collect()] == ["a", "b", "d", "c"]


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e\n1,x,True,1.5,NA\n2,"q,""r""",False,NaN,n/a\nNA,null,True,3,\n')
    df = tables.load(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "boolean"), ("d", "double"), ("e", "double")]
    assert rows(df) == [(1, "x", True, 1.5, None), (2, 'q,"r"', False, None, None), (None, None, True, 3.0, None)]


def test_json_array_and_lines(spark, tmp_path):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "t.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(d) for d in data))
    for name in ("t.json", "t.jsonl"):
        assert rows(tables.load(spark, str(tmp_path / name))) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path / "t.xlsx"))


def test_sink_names_and_failed_save(spark, tmp_path):
    assert sinks.plain_name("a b/c-d_é") == "a_b_c-d_é"

    class Broken:
        def write(self):
            raise OSError("full")

    assert sinks.save_best(Broken(), "x", str(tmp_path)) is None


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], ["x.y", "a`b"])
    assert clean.columns_with_nulls(df, df.columns) == ["x.y"]
    assert rows(clean.fill_remaining(df)) == [(1.0, "a"), (1.0, "b")]
    assert rows(clean.impute(df, ["x.y"], "drop_rows")) == [(1.0, "a")]
    assert features.label_encode(df, ["a`b"]).columns == ["x.y", "a`b"]
    assert profile.describe(df).first()["column"] == "x.y"


def test_nested_columns(spark):
    df = spark.sql("SELECT map('a', 1, 'b', id) AS m, array(1) AS l, 1 AS k FROM range(3) UNION ALL "
                   "SELECT map('b', 2L, 'a', 1) AS m, array(1) AS l, 1 AS k")
    assert profile.duplicate_rows(df).first()[0] == 1
    found = profile.profile(df)
    assert found.skipped == ["m", "l"] and found.constants == ["k"]


def test_sketched_counts_decide_like_exact_ones(spark):
    df = spark.range(20000).selectExpr("id", "id % 50 AS fifty", "id % 51 AS more", "concat('x', id % 10001) AS half",
                                       "concat('x', id % 9000) AS less", "CASE WHEN id < 19500 THEN id ELSE 0 END AS almost")
    exact = {r["column"]: r["n_unique"] for r in cardinality(df).collect()}
    cuts = (1, 50, 10000, 19600)
    quick = judged_cardinality(df, cuts)
    assert all((quick[c] > cut) == (exact[c] > cut) for c in exact for cut in cuts)
    assert [quick[c] for c in ("id", "fifty", "more", "half", "almost")] == [20000, 50, 51, 10001, 19500]
    assert validate.validate(df, "more", order_by=["id"]).fixes == {"id": "drop_id", "half": "drop_high_cardinality"}
    assert validate.validate(df, "more", order_by=["id"], exact=False).fixes == {"id": "drop_id", "half": "drop_high_cardinality"}
    assert validate.validate(df, "more", order_by=["id"]).n_unique == exact


def test_numbers_stay_when_made_times(spark):
    df = spark.createDataFrame([(5, "2020-01-02T03:04:05", "12345")], "n int, t string, y string")
    out = clean.convert(df, ["n", "t", "y"], "datetime")
    assert [str(v) for v in out.first()] == ["5", "2020-01-02 03:04:05", "None"]


def test_order_is_tested_on_whole_numbers(spark):
    """Neighbours above 2 ** 53 are one double; their falls must still be found."""
    base = 2**60
    df = spark.range(1000).selectExpr("id", f"{base}L + id + 2 * (id % 2) AS down", f"{base}L + id AS up",
                                      f"cast({base}L + id as decimal(30,0)) * 1000000 + 1 AS wide")
    assert validate.order_falls(df, ["down", "up", "wide"], ["id"]) == {"down": 499, "up": 0, "wide": 0}


def test_names_used_twice(spark):
    df = spark.range(5).selectExpr("id", "id AS a", "id + 1 AS a", "id AS `a.2`")
    assert [i[:2] for i in validate.validate(df, "id").issues if i[1] == "duplicate_name"] == [("a", "duplicate_name")]


def test_dotted_names_in_a_plan(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (3.0, 3)], "`a.b` double, y int")
    made = prepare.run_cleaning(df, [{"step": "handle_missing", "columns": ["a.b"], "method": "drop_rows"}], "y")
    assert made.df.count() == 2


def test_nan_is_filled(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert [r.x for r in clean.impute(df, ["x"]).collect()] == [1.0, 2.0, 3.0]


def test_whole_numbers_of_any_length_from_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1234567890123456789,12345678901234567890,1\n1234567890123456791,1,1.5\n")
    df = tables.load(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "double"}
    assert [r.a for r in df.orderBy("a").collect()] == [1234567890123456789, 1234567890123456791]
