"""The small aggregates behind feature-against-target charts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_feature
from ..functions.hashing import key_hash
from ..functions.order_stats import quantiles

BOX_LEVELS = 12
CLASS_LEVELS = 8
TAB_LEVELS = 10
NULL_LABEL = "null"
REACH = 1.5
Z95 = 1.959963984540054  # 97.5 % point of the normal distribution


def pick_charts(df: DataFrame, target: str, limit: int | None = None) -> list[tuple[str, str]]:
    """``(feature, chart)`` for all features, or the first ``limit``, numbers before the rest."""
    numeric = {f.name for f in df.schema.fields if is_feature(f.dataType)}
    others = [c for c in df.columns if c != target]
    ordered = [c for c in others if c in numeric] + [c for c in others if c not in numeric]
    kinds = {(True, True): "scatter", (False, True): "box", (True, False): "box_by_target", (False, False): "crosstab"}
    return [(c, kinds[(c in numeric, target in numeric)]) for c in ordered[:limit]]


def as_level(name: str):
    return F.coalesce(col(name).cast("string"), F.lit(NULL_LABEL))


def top_levels(df: DataFrame, column: str, k: int) -> DataFrame:
    """``level, n``: the k most frequent values as text, the smaller one first on ties."""
    counts = df.groupBy(as_level(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "level").limit(k)


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line with what its confidence band needs, in one aggregate."""
    a, b = col(x).cast("double"), col(y).cast("double")
    out = df.agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_count(b, a).alias("n"), F.regr_avgx(b, a).alias("x_mean"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"),
        F.min(F.when(b.isNotNull(), a)).alias("x_min"), F.max(F.when(b.isNotNull(), a)).alias("x_max"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return out.withColumn("residual_std", F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0)))).drop("syy", "sxy")


def trend_band(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """``x, fitted, lower, upper`` along an even grid: the line and its 95 % band in closed form."""
    grid = trend(df, x, y).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("x_min") + F.col("_i") / F.lit(float(points - 1)) * (F.col("x_max") - F.col("x_min"))
    grid = grid.withColumn("x", at).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x"))
    off = F.col("x") - F.col("x_mean")
    half = F.lit(Z95) * F.col("residual_std") * F.sqrt(1 / F.col("n") + off * off / F.nullif(F.col("sxx"), F.lit(0.0)))
    return grid.select("x", "fitted", (F.col("fitted") - half).alias("lower"), (F.col("fitted") + half).alias("upper"))


def _poisson_weights() -> np.ndarray:
    """How often a bootstrap draws a row, for each value of 16 bits: the Poisson law with mean 1."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(float)


def _replicate_multipliers(replicates: int, seed: int) -> list[int]:
    return [2 * int(hashlib.md5(f"{seed}|{r}".encode()).hexdigest()[:15], 16) + 1 for r in range(replicates)]


def bootstrap_lines(df: DataFrame, x: str, y: str, keys: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``replicate, slope, intercept``: least-squares lines of Poisson bootstrap replicates.

    A row's weight in a replicate follows from the hash of its key alone, times the replicate's odd multiplier, so nothing
    is drawn, moved or repeated: each task passes on five sums per replicate. Rows that lack x or y are left out.
    """
    a, b = col(x).cast("double"), col(y).cast("double")
    rows = df.select(key_hash(keys).alias("hash"), a.alias("x"), b.alias("y")).dropna(subset=["x", "y"])
    rows = rows.select(F.coalesce("hash", F.lit(0)).alias("hash"), "x", "y").where("not isnan(x) and not isnan(y)")
    middle = rows.agg(F.avg("x"), F.avg("y")).first()
    x_mean, y_mean = middle[0] or 0.0, middle[1] or 0.0
    factors = np.array(_replicate_multipliers(replicates, seed), np.uint64)
    names = ["n", "sx", "sy", "sxx", "sxy"]
    schema = pa.schema([("replicate", pa.int32()), *[(c, pa.float64()) for c in names]])

    def run(batches):
        weights, sums = _poisson_weights(), np.zeros((5, replicates))
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                h, u, v = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                u, v = u - x_mean, v - y_mean
                drawn = weights[(h.astype(np.uint64)[:, None] * factors[None]) >> np.uint64(48)]
                sums += np.stack([np.ones(len(u)), u, v, u * u, u * v]) @ drawn
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), *[pa.array(s) for s in sums]], schema=schema)

    total = rows.mapInArrow(run, "replicate int, " + ", ".join(f"{c} double" for c in names)).groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in names])
    n = F.nullif(F.col("n"), F.lit(0.0))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.nullif(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.lit(0.0))
    lines = total.select("replicate", slope.alias("slope"), (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my"))
    return lines.select("replicate", "slope", (F.col("my") + y_mean - F.col("slope") * (F.col("mx") + x_mean)).alias("intercept"))


def bootstrap_band(df: DataFrame, x: str, y: str, keys: Sequence[str], replicates: int = 1000, points: int = 100, seed: int = 42) -> DataFrame:
    """``x, fitted, lower, upper`` along an even grid: the line, and between which the middle 95 % of the replicates' lines lie."""
    grid = trend(df, x, y).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("x_min") + F.col("_i") / F.lit(float(max(points - 1, 1))) * (F.col("x_max") - F.col("x_min"))
    grid = grid.select("_i", at.alias("x"), (F.col("intercept") + F.col("slope") * at).alias("fitted"))
    lines = bootstrap_lines(df, x, y, keys, replicates, seed).agg(F.collect_list(F.struct("slope", "intercept")).alias("_lines"))
    # replicates x points: both are arguments, the rows of the table play no part any more
    each = grid.join(F.broadcast(lines)).select("_i", "x", "fitted", F.explode("_lines").alias("_line"))
    value = F.col("_line.intercept") + F.col("_line.slope") * F.col("x")
    return each.groupBy("_i", "x", "fitted").agg(F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper")).drop("_i")


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """All points, or ``n`` drawn by key hash, so that the same points come back every time."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    if n is not None:
        both = both.orderBy(key_hash(keys), *[col(k) for k in keys]).limit(n)
    return both.select(*[col(k) for k in keys], col(x).alias("x"), col(y).alias("y"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """``x_bin, y_bin, n``: how many of all points fall into each cell of an even grid; empty cells are left out."""
    both = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = both.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n bigint")

    def cell(name: str, low: float, high: float):
        place = F.floor((F.col(name) - F.lit(low)) / F.lit(high - low) * bins) if high > low else F.lit(0)
        return F.least(place, F.lit(bins - 1)).cast("int").alias(f"{name}_bin")

    return both.groupBy(cell("x", ends[0], ends[1]), cell("y", ends[2], ends[3])).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, level: str, value: str, k: int = BOX_LEVELS) -> DataFrame:
    """``level, n, q1, median, q3, whisker_low, whisker_high, n_outliers`` of the k top levels.

    Quartiles are exact and no level is gathered in one task. Whiskers are the
    extreme values within 1.5 quartile distances of the box.
    """
    levels = [r["level"] for r in top_levels(df, level, k).collect()]
    rows = df.select(as_level(level).alias("level"), col(value).cast("double").alias("v")).where(
        F.col("level").isin(levels) & F.col("v").isNotNull())
    found = quantiles(rows, ["v"], (0.25, 0.5, 0.75), "level")
    boxes = []
    for (name, _), (q1, q2, q3) in found.items():
        if q1 is not None:
            reach = REACH * (q3 - q1)
            boxes.append((name, q1, q2, q3, q1 - reach, q3 + reach))
    table = df.sparkSession.createDataFrame(
        boxes, "level string, q1 double, median double, q3 double, _lo double, _hi double")
    inside = F.col("v").between(F.col("_lo"), F.col("_hi"))
    return rows.join(F.broadcast(table), "level").groupBy("level", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def crosstab(df: DataFrame, x: str, y: str, k: int = TAB_LEVELS) -> DataFrame:
    """``x, y, n`` over the k top levels of both columns, with 0 for pairs that never meet."""
    tops = [[r["level"] for r in top_levels(df, c, k).collect()] for c in (x, y)]
    cells = df.select(as_level(x).alias("x"), as_level(y).alias("y")).where(
        F.col("x").isin(tops[0]) & F.col("y").isin(tops[1]))
    counts = cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    found = {(r["x"], r["y"]): r["n"] for r in counts.collect()}  # at most k * k rows
    seen_x, seen_y = {a for a, _ in found}, {b for _, b in found}
    grid = [(a, b, found.get((a, b), 0)) for a in tops[0] if a in seen_x for b in tops[1] if b in seen_y]
    return df.sparkSession.createDataFrame(grid, T.StructType([
        T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("n", T.LongType())]))


def chart_data(df: DataFrame, target: str, keys: Sequence[str], limit: int | None = None) -> dict[str, DataFrame]:
    """The table behind each chart of a target, by ``feature_vs_target`` name."""
    makers = {
        "scatter": lambda f: scatter_points(df, f, target, keys),
        "box": lambda f: box_stats(df, f, target, BOX_LEVELS),
        "box_by_target": lambda f: box_stats(df, target, f, CLASS_LEVELS),
        "crosstab": lambda f: crosstab(df, f, target),
    }
    out = {}
    for feature, kind in pick_charts(df, target, limit):
        out[f"{feature}_vs_{target}"] = makers[kind](feature)
        if kind == "scatter":
            out[f"{feature}_vs_{target}_trend"] = trend_band(df, feature, target)
    return out
