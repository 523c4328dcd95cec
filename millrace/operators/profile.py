"""Column and table statistics. Every result is a small tidy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import chunks, col, is_number, is_text, null_nan, number_names, text_names
from ..functions.order_stats import quantiles
from ..functions.storage import stored
from ..functions.value_counts import cardinality, column_name, countable, judged_cardinality, value_counts

HIGH_CARDINALITY = 50
COUNT_CUTS = (1, HIGH_CARDINALITY)
SKEW_LIMIT = 1.0
WIDE = 50  # columns per aggregate, to stay within generated-code limits
BROADCAST_HASHES = 1_000_000  # 8 MB of row hashes


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One row per column from fused aggregates: ``measures`` maps a name to ``f(Column)``."""
    out = None
    for part in chunks(list(columns), WIDE):
        row = df.agg(*[f(col(c)).alias(f"{m}_{i}") for i, c in enumerate(part) for m, f in measures.items()])
        cells = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
            for i, c in enumerate(part)
        ]
        table = row.select(F.inline(F.array(*cells)))
        out = table if out is None else out.unionAll(table)
    return out


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def missing(df: DataFrame) -> DataFrame:
    """``column, missing, missing_pct``."""
    counts = _per_column(df, df.columns, {
        "missing": lambda c: F.count_if(c.isNull()), "_rows": lambda c: F.count(F.lit(1))})
    return counts.select(
        "column", "missing",
        F.round(_share(F.col("missing") * 100.0, F.col("_rows")), 2).alias("missing_pct"))


def missing_cells(df: DataFrame) -> DataFrame:
    return missing(df).agg(F.sum("missing").alias("missing_cells"))


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, mean, std, min, max`` of number columns in one pass."""
    return _per_column(df, number_names(df) if columns is None else columns, {
        "count": F.count,
        "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    })


def describe(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Moments with the 25, 50 and 75 % quantiles, exact unless ``approx``. NaN is missing."""
    df = null_nan(df)
    cols = number_names(df) if columns is None else list(columns)
    if approx:
        points = _per_column(df, cols, {
            "_q": lambda c: F.percentile_approx(c.cast("double"), F.array(F.lit(.25), F.lit(.5), F.lit(.75)))})
        points = points.select("column", *[
            F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    else:
        found = quantiles(df, cols, (0.25, 0.5, 0.75))
        points = df.sparkSession.createDataFrame(
            [(c, *found[c]) for c in cols], "column string, q25 double, q50 double, q75 double")
    return moments(df, cols).join(F.broadcast(points), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def high_cardinality(df: DataFrame, limit: int = HIGH_CARDINALITY) -> DataFrame:
    return cardinality(df, text_names(df)).where(F.col("n_unique") > limit)


def constant_columns(df: DataFrame) -> DataFrame:
    return cardinality(df).where(F.col("n_unique") <= 1)


def _comparable(field: T.StructField) -> Column:
    """Maps cannot be grouped; their sorted entries can."""
    c = col(field.name)
    return F.array_sort(F.map_entries(c)).alias(field.name) if isinstance(field.dataType, T.MapType) else c


def repeated_hashes(df: DataFrame) -> DataFrame:
    """``_hash_``: the 64-bit row hashes that occur more than once, stored."""
    hashes = df.select(F.xxhash64(*[col(c) for c in df.columns]).alias("_hash_")).groupBy("_hash_")
    return stored(hashes.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash_"), "repeated")


def duplicate_rows(df: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each group of equal rows, nulls equal.

    Only a hash per row is shuffled at first, so a table without copies moves 8
    bytes a row. Whole rows are compared just for hashes that repeat, if those are
    few enough to broadcast. Either way copies are counted map-side before a shuffle.
    """
    df = df.select(*[_comparable(f) for f in df.schema.fields])
    repeated = repeated_hashes(df)
    if repeated.count() <= broadcast_hashes:
        hashed = df.withColumn("_hash_", F.xxhash64(*[col(c) for c in df.columns]))
        df = hashed.join(F.broadcast(repeated), "_hash_", "left_semi").drop("_hash_")
    same = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n_"))
    return same.agg(F.coalesce(F.sum(F.col("_n_") - 1), F.lit(0)).alias("duplicate_rows"))


def corrected_skew(c: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    c = c.cast("double")
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def skew(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, skew, is_skewed``."""
    cols = number_names(df) if columns is None else columns
    found = _per_column(df, cols, {"skew": corrected_skew})
    return found.withColumn("is_skewed", F.coalesce(F.abs("skew") > SKEW_LIMIT, F.lit(False)))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, max_columns: int | None = None) -> DataFrame:
    """``column, value, n, share``: the k most frequent values of each text column (of the first ``max_columns``).

    Ties go to the smaller value. Each task keeps k rows per column before the
    ranking shuffle (window group limit), so no column is ranked whole in one task.
    """
    cols = (text_names(df)[:max_columns] if columns is None else list(columns))
    text = df.select(*[col(c).cast("string").alias(c) for c in cols])
    counts = value_counts(text, cols).select("cid", F.col("s").alias("value"), "n")
    filled = _per_column(text, cols, {"_filled": F.count})
    first = Window.partitionBy("cid").orderBy(F.desc("n"), "value")
    top = counts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return (
        top.select(column_name(cols).alias("column"), "value", "n")
        .join(F.broadcast(filled), "column")
        .select("column", "value", "n", (F.col("n") / F.col("_filled")).alias("share"))
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are set; null where either does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """``column, r`` of each other number column, strongest first; empty for a non-number target."""
    cols = [c for c in number_names(df) if c != target]
    if not cols or not is_number(df.schema[target].dataType):
        return df.sparkSession.createDataFrame([], "column string, r double")
    found = _per_column(df, cols, {"r": lambda c: pearson(c, col(target))})
    return found.orderBy(F.abs("r").desc_nulls_last(), "column")


def target_summary(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Mean, std, min, max, n_unique of a number target; the k top values of any other."""
    t = col(target)
    if is_number(df.schema[target].dataType):
        return df.agg(
            F.avg(t.cast("double")).alias("mean"), F.stddev_samp(t.cast("double")).alias("std"),
            F.min(t).cast("double").alias("min"), F.max(t).cast("double").alias("max"),
            F.count_distinct(t).alias("n_unique"))
    counts = df.where(t.isNotNull()).groupBy(t.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def column_context(df: DataFrame) -> DataFrame:
    """``column, dtype, n_unique`` for every column."""
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    return types.join(F.broadcast(cardinality(df)), "column", "left")


@dataclass(frozen=True)
class Profile:
    """The numbers the planning rules need, one entry per column."""

    n_rows: int
    dtypes: dict[str, str]
    numeric: list[str]
    text: list[str]
    missing: dict[str, int]
    n_unique: dict[str, int]
    skewed: list[str]
    duplicates: int
    skew: dict[str, float | None] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)  # nested columns, whose values are not counted

    @property
    def high_cardinality(self) -> list[str]:
        return [c for c in self.text if self.n_unique.get(c, 0) > HIGH_CARDINALITY]

    @property
    def constants(self) -> list[str]:
        return [c for c in self.dtypes if self.n_unique.get(c, 2) <= 1]


def profile(df: DataFrame, exact: bool = True, known_unique: dict[str, int] | None = None) -> Profile:
    """Row count, nulls, skew, cardinality and copies of a table.

    Counts and skew share one scan. Distinct counts are exact, or without
    ``exact`` only near the limits the plans use and estimates elsewhere; ``known_unique`` gives those found before.
    """
    numeric, text = number_names(df), text_names(df)
    n_rows, nulls, skews = 0, {}, {}
    for part in chunks(df.columns, WIDE):
        measures = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(part)]
        measures += [corrected_skew(col(c)).alias(f"s{i}") for i, c in enumerate(part) if c in numeric]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first()
        n_rows = row["rows"]
        nulls.update({c: row[f"n{i}"] for i, c in enumerate(part)})
        skews.update({c: row[f"s{i}"] for i, c in enumerate(part) if c in numeric})
    unique = {c: n for c, n in (known_unique or {}).items() if c in nulls}
    rest = [c for c in countable(df) if c not in unique]
    if rest:
        unique |= ({r["column"]: r["n_unique"] for r in cardinality(df, rest).collect()} if exact
                   else judged_cardinality(df, COUNT_CUTS, rest))
    return Profile(
        n_rows=n_rows,
        dtypes=dict(df.dtypes),
        numeric=numeric,
        text=text,
        missing=nulls,
        n_unique=unique,
        skewed=[c for c in numeric if skews[c] is not None and abs(skews[c]) > SKEW_LIMIT],
        duplicates=duplicate_rows(df).first()["duplicate_rows"],
        skew=skews,
        skipped=[c for c in df.columns if c not in unique],
    )


def column_stats(df: DataFrame) -> DataFrame:
    """Nulls of every column and, for numbers, moments, range and skew, from one scan."""
    makers = {
        "count": lambda c: F.count(c), "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")), "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"), "skew": corrected_skew,
    }
    out = None
    for part in chunks(df.schema.fields, WIDE):
        measures, cells = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(part):
            measures.append(F.count_if(col(f.name).isNull()).alias(f"missing_{i}"))
            numeric = is_number(f.dataType)
            measures += [make(col(f.name)).alias(f"{m}_{i}") for m, make in makers.items() if numeric]
            cells.append(F.struct(
                F.lit(f.name).alias("column"), F.col(f"missing_{i}").alias("missing"),
                F.round(_share(F.col(f"missing_{i}") * 100.0, F.col("rows")), 2).alias("missing_pct"),
                *[(F.col(f"{m}_{i}") if numeric else F.lit(None)).cast("bigint" if m == "count" else "double").alias(m)
                  for m in makers]))
        table = df.agg(*measures).select(F.inline(F.array(*cells)))
        out = table if out is None else out.unionAll(table)
    flag = F.when(F.col("count").isNotNull(), F.coalesce(F.abs("skew") > SKEW_LIMIT, F.lit(False)))
    return out.withColumn("is_skewed", flag)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, cardinality, distribution, skew, flags."""
    points = quantiles(df, number_names(df), (0.25, 0.5, 0.75)) if number_names(df) else {}
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(),
          "number" if is_number(f.dataType) else "text" if is_text(f.dataType) else "other",
          *points.get(f.name, [None] * 3)) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, kind string, q25 double, q50 double, q75 double")
    out = types.join(F.broadcast(column_stats(df)), "column").join(F.broadcast(cardinality(df)), "column", "left")
    return out.withColumns({
        "is_constant": F.col("n_unique") <= 1,
        "is_high_cardinality": (F.col("kind") == "text") & (F.col("n_unique") > HIGH_CARDINALITY),
    }).orderBy("position")
