"""Cleaning steps. Fitted steps return plain parameters that apply to any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chunks, col, is_number, is_text, is_time, null_nan, present
from ..functions.order_stats import quantiles
from ..functions.parsing import num_parse, time_parse
from ..functions.value_counts import modes
from .profile import BROADCAST_HASHES, repeated_hashes

UNKNOWN = "Unknown"
FENCE = 1.5
Z_LIMIT = 3.0
Z_GUARD = 1e-9


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    found = []
    for part in chunks(list(columns), 200):
        row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(part)]).first()
        found += [c for i, c in enumerate(part) if row[f"n{i}"]]
    return found


# Missing values ------------------------------------------------------------

def fit_fill(df: DataFrame, columns: Sequence[str], method: str = "median") -> dict[str, object]:
    """Fill value per column with nulls. Text takes its mode whatever the method;
    an unknown method means median."""
    affected = columns_with_nulls(df, present(df, columns))
    numbers = [c for c in affected if is_number(df.schema[c].dataType)]
    by_mode = [c for c in affected if c not in numbers or method == "mode"]
    fills: dict[str, object] = {}
    if by_mode:
        found = modes(df, by_mode)
        fills.update({c: found.get(c, 0 if c in numbers else UNKNOWN) for c in by_mode})
    rest = [c for c in numbers if method != "mode"]
    if rest and method == "mean":
        row = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(rest)]).first()
        fills.update({c: row[f"m{i}"] for i, c in enumerate(rest)})
    elif rest:
        fills.update({c: q[0] for c, q in quantiles(df, rest, (0.5,)).items()})
    return {c: fills[c] for c in affected}


def apply_fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Put the fill value in place of nulls; a fractional fill widens a number column to double."""
    def filled(c: str, value: object) -> Column:
        dtype = df.schema[c].dataType
        if value is None:
            return col(c)
        if is_number(dtype):
            kind = "double" if isinstance(value, float) else dtype
            return F.coalesce(col(c).cast(kind), F.lit(value).cast(kind))
        return F.coalesce(col(c), F.lit(value).try_cast(dtype))

    mine = {c: filled(c, v) for c, v in fills.items() if c in df.columns}
    return df.withColumns(mine) if mine else df


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of the columns out."""
    names = ["`" + c.replace("`", "``") + "`" for c in columns]
    return df.na.drop("any", subset=names) if names else df


def impute(df: DataFrame, columns: Sequence[str], method: str = "median") -> DataFrame:
    """Methods: median, mean, mode, drop_rows, drop_cols. NaN is missing, too."""
    df = null_nan(df)
    if method in ("drop_rows", "drop_cols"):
        affected = columns_with_nulls(df, present(df, columns))
        if not affected:
            return df
        if method == "drop_cols":
            return df.drop(*affected)
        return drop_null_rows(df, affected)
    return apply_fill(df, fit_fill(df, columns, method))


def fill_remaining(df: DataFrame, target: str | None = None) -> DataFrame:
    """Last fill of every column but the target: median for numbers, mode for the rest. NaN is missing, too."""
    df = null_nan(df)
    return apply_fill(df, fit_fill(df, [c for c in df.columns if c != target], "median"))


# Outliers ------------------------------------------------------------------

def _numbers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in present(df, columns) if is_number(df.schema[c].dataType)]


def fit_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Quartiles widened by 1.5 times their distance, per number column."""
    fences = {}
    for c, (q1, q3) in quantiles(df, _numbers(df, columns), (0.25, 0.75)).items():
        if q1 is not None:
            reach = FENCE * (q3 - q1)
            fences[c] = (q1 - reach, q3 + reach)
    return fences


def clip(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Pull values to the nearer fence; nulls stay null."""
    return df.withColumns({
        c: F.when(col(c).isNotNull(), F.greatest(F.least(col(c).cast("double"), F.lit(hi)), F.lit(lo)))
        for c, (lo, hi) in fences.items()})


def keep_within(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside every fence; a null is inside none."""
    keep = F.lit(True)
    for c, (lo, hi) in fences.items():
        keep = keep & col(c).cast("double").between(lo, hi)
    return df.where(keep)


def fit_zscore(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per number column."""
    cols = _numbers(df, columns)
    if not cols:
        return {}
    row = df.agg(*[
        f(col(c).cast("double")).alias(f"{n}{i}")
        for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def keep_zscore(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows within three deviations of the mean on every column; nulls drop out."""
    keep = F.lit(True)
    for c, (mean, std) in stats.items():
        z = (col(c).cast("double") - F.lit(mean)) / (F.lit(std) + Z_GUARD)
        keep = keep & (F.abs(z) <= Z_LIMIT)
    return df.where(keep)


def trim_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr") -> DataFrame:
    """Methods: clip, zscore; anything else drops rows outside the fences."""
    if not _numbers(df, columns):
        return df
    if method == "clip":
        return clip(df, fit_fences(df, columns))
    if method == "zscore":
        return keep_zscore(df, fit_zscore(df, columns))
    return keep_within(df, fit_fences(df, columns))


# Columns, types and rows ----------------------------------------------------

def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop whatever is listed and present."""
    return df.drop(*present(df, columns))


def convert(df: DataFrame, columns: Sequence[str], kind: str = "numeric") -> DataFrame:
    """``numeric``, ``datetime`` or ``string``; values that do not parse become null.

    Numbers are not read as times and stay as they are.
    """
    makers = {
        "numeric": lambda f: col(f.name) if is_number(f.dataType) else num_parse(f),
        "datetime": lambda f: time_parse(f) if is_text(f.dataType) or is_time(f.dataType) else col(f.name),
        "string": lambda f: col(f.name) if is_text(f.dataType) else col(f.name).cast("string"),
    }
    make = makers.get(kind)
    cols = present(df, columns)
    return df.withColumns({c: make(df.schema[c]) for c in cols}) if make and cols else df


def drop_duplicates(df: DataFrame, few: bool = False, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One of each group of equal rows. Copies collapse map-side, so a hot row is no hot spot.

    Dropping copies shuffles whole rows. If copies are known to be ``few``, only a
    64-bit hash per row is shuffled to find the hashes that repeat; rows with other
    hashes stay where they are and just the candidates are compared. Too many
    repeated hashes to broadcast leads back to the plain way.
    """
    if not few:
        return df.dropDuplicates()
    repeated = repeated_hashes(df)
    if repeated.count() > broadcast_hashes:
        return df.dropDuplicates()
    hashed = df.withColumn("_hash_", F.xxhash64(*[col(c) for c in df.columns]))
    single = hashed.join(F.broadcast(repeated), "_hash_", "left_anti").drop("_hash_")
    copies = hashed.join(F.broadcast(repeated), "_hash_", "left_semi").drop("_hash_")
    return single.unionByName(copies.dropDuplicates())


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull()) if target in df.columns else df
