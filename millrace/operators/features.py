"""Feature steps: codes, transforms, date and name parts, the feature matrix."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_feature, is_number, is_text, present, text_names
from ..functions.parsing import time_parse
from ..functions.running import running_sum
from ..functions.storage import stored
from ..functions.value_counts import slot_value, value_counts

# A code table up to this many levels is sorted once and broadcast; a longer one
# is numbered range by range and joined by shuffle.
BROADCAST_LEVELS = 200_000
MISSING_CODE = -1
NAME_SHARE = 0.7
TIME_SHARE = 0.5

# Fixed pattern: the part between a comma and the next full stop.
TITLE_PATTERN = r",\s*([^.]+)\."

# Fixed table: the group of each title. Titles not listed are Rare.
TITLE_GROUPS = {
    "Mr": "Mr",
    "Mrs": "Mrs",
    "Miss": "Miss",
    "Master": "Master",
    "Mme": "Mrs",
    "Ms": "Miss",
    "Mlle": "Miss",
}
RARE_TITLE = "Rare"

# Fixed lists: column names that hold sibling/spouse and parent/child counts.
SIBLING_NAMES = ("sibsp", "siblings", "sibling_spouse", "sib_sp", "num_siblings")
PARENT_NAMES = ("parch", "parents", "parent_child", "par_ch", "num_parents")


# Label codes -----------------------------------------------------------------

@dataclass(frozen=True)
class Codes:
    """Sorted distinct values of one column with their positions."""

    column: str
    table: DataFrame  # level, code
    small: bool


def _level_table(df: DataFrame, column: str, levels: list) -> DataFrame:
    schema = T.StructType([T.StructField("level", df.schema[column].dataType),
                           T.StructField("code", T.IntegerType())])
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(sorted(levels))], schema)


def _short_levels(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """Distinct values of columns known to have few, most of them from one shuffle."""
    shared = [c for c in columns if not isinstance(df.schema[c].dataType, (T.BooleanType, T.DecimalType))]
    found: dict[str, list] = {c: [] for c in columns}
    for r in value_counts(df, shared).collect() if shared else []:
        name = shared[r["cid"]]
        found[name].append(slot_value(r, df.schema[name].dataType))
    for c in columns:
        if c not in shared:
            found[c] = [r[0] for r in df.select(col(c)).where(col(c).isNotNull()).distinct().collect()]
    return found


def _long_codes(df: DataFrame, column: str) -> Codes:
    """Number the levels range by range; no task and not the driver holds them all."""
    levels = df.where(col(column).isNotNull()).groupBy(col(column).alias("level")).agg(F.lit(1).alias("one"))
    table = running_sum(levels, ["level"], ["one"]).select("level", F.col("before_one").cast("int").alias("code"))
    return Codes(column, stored(table, "codes"), False)


def fit_codes(df: DataFrame, columns: Sequence[str], broadcast_levels: int = BROADCAST_LEVELS) -> list[Codes]:
    """Number the sorted distinct values of each column from 0.

    One sketch pass tells short columns from long ones. Short ones are read
    together, a bounded number of levels at a time; the rest are numbered by Spark.
    """
    cols = list(columns)
    if not cols:
        return []
    row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    short = [c for c in cols if sizes[c] <= broadcast_levels]
    fitted: dict[str, Codes] = {}
    batch: list[str] = []
    for i, c in enumerate(short):
        batch.append(c)
        if i + 1 == len(short) or sum(sizes[b] for b in batch) + sizes[short[i + 1]] > broadcast_levels:
            for name, levels in _short_levels(df, batch).items():
                fitted[name] = Codes(name, _level_table(df, name, levels), True)
            batch = []
    return [fitted.get(c) or _long_codes(df, c) for c in cols]


def apply_codes(df: DataFrame, codes: Sequence[Codes], output: dict[str, str] | None = None) -> DataFrame:
    """Replace values by codes; null and values not seen at fit time become -1.

    A broadcast table moves no rows. A long one is joined by shuffle, where
    adaptive execution splits the partition of a hot value.
    """
    for item in codes:
        name = (output or {}).get(item.column, item.column)
        table = item.table.select(F.col("level").alias("_level_"), F.col("code").alias("_code_"))
        joined = df.join(F.broadcast(table) if item.small else table, col(item.column) == F.col("_level_"), "left")
        code = F.coalesce(F.col("_code_"), F.lit(MISSING_CODE)).cast("int")
        kept = [code.alias(name) if c == name else col(c) for c in df.columns]
        if name not in df.columns:
            kept.append(code.alias(name))
        df = joined.select(*kept)
    return df


def label_encode(df: DataFrame, columns: Sequence[str], target: str | None = None,
                 broadcast_levels: int = BROADCAST_LEVELS) -> DataFrame:
    cols = present(df, columns, target)
    return apply_codes(df, fit_codes(df, cols, broadcast_levels)) if cols else df


# One-hot ----------------------------------------------------------------------

def fit_levels(df: DataFrame, columns: Sequence[str], max_levels: int = 10_000) -> dict[str, list]:
    """Sorted levels per column. More than ``max_levels`` output columns is refused, not cut."""
    cols = list(columns)
    if not cols:
        return {}
    row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        if row[f"n{i}"] > max_levels:
            raise ValueError(f"{c!r} has more than {max_levels} levels; label-encode it")
    return {c: sorted(levels) for c, levels in _short_levels(df, cols).items()}


def one_hot(df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None) -> DataFrame:
    """A flag per level but the first, named ``column_value``; null sets none; the source goes."""
    cols = present(df, columns)
    levels = levels if levels is not None else fit_levels(df, cols)
    flags = [
        F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in cols for v in levels[c][1:]
    ]
    return df.select(*[col(c) for c in df.columns if c not in cols], *flags)


@dataclass(frozen=True)
class SparseLevels:
    """Codes of some columns, where each column's slots begin, and how many slots there are."""

    codes: tuple[Codes, ...]
    offsets: tuple[int, ...]
    width: int


def fit_sparse_levels(df: DataFrame, columns: Sequence[str], broadcast_levels: int = BROADCAST_LEVELS) -> SparseLevels:
    """A slot per level but the first of each column, numbered in the order of columns and levels, however many there are."""
    codes = fit_codes(df, list(columns), broadcast_levels)
    sizes = [max(c.table.count() - 1, 0) for c in codes]
    width = sum(sizes)
    if width >= 1 << 31:
        raise ValueError(f"{width} levels are more than a vector has places")
    return SparseLevels(tuple(codes), tuple(itertools.accumulate([0, *sizes[:-1]])), width)


def one_hot_slots(df: DataFrame, columns: Sequence[str], levels: SparseLevels | None = None, output: str = "slots") -> DataFrame:
    """Add ``output``: the ascending slots of a row's levels; null, first and unknown levels have none. The sources go."""
    cols = present(df, columns)
    levels = levels or fit_sparse_levels(df, cols)
    taken = {c.lower() for c in df.columns}
    names = {c.column: next(n for n in (f"_code_{i}" + "_" * k for k in itertools.count()) if n not in taken) for i, c in enumerate(levels.codes)}
    coded = apply_codes(df, levels.codes, names)
    slots = [F.when(col(names[c.column]) > 0, col(names[c.column]) - 1 + F.lit(at)) for c, at in zip(levels.codes, levels.offsets)]
    found = F.filter(F.array(*slots).cast("array<int>"), lambda s: s.isNotNull()) if slots else F.array().cast("array<int>")
    return coded.select(*[col(c) for c in df.columns if c not in cols], found.alias(output))


def sparse_features(df: DataFrame, features: Sequence[str], width: int, slots: str = "slots", output: str = "features") -> DataFrame:
    """Replace number and flag columns and the slots by one sparse vector: the numbers' places first, then ``width`` slots.

    The vector is written as the structure that a vector is stored as and read back as a vector, so no row passes through
    Python and no column or attribute is made per level.
    """
    numbers = [F.coalesce(_double(df, c), F.lit(0.0)) for c in features]
    filled = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), n.alias("value")) for i, n in enumerate(numbers)]), lambda e: e.value != 0) if numbers else None
    spots = F.transform(col(slots), lambda s: s + F.lit(len(numbers)))
    ones = F.transform(col(slots), lambda s: F.lit(1.0))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(len(numbers) + width).alias("size"),
        (F.concat(filled.at, spots) if numbers else spots).alias("indices"), (F.concat(filled.value, ones) if numbers else ones).alias("values"))
    kept = [c for c in df.columns if c not in features and c != slots]
    return stored(df.select(*[col(c) for c in kept], vector.alias(output)), "sparse", read_as={output: VectorUDT()})


def is_sex_name(name: str) -> bool:
    return re.sub("[^a-z0-9]", "", name.lower()) == "sex"


def encode(df: DataFrame, columns: Sequence[str], method: str = "label", target: str | None = None) -> DataFrame:
    """``onehot``, or label codes for any other method. A sex column always gets label codes."""
    cols = present(df, columns, target)
    hot = [c for c in cols if method == "onehot" and not is_sex_name(c)]
    df = label_encode(df, [c for c in cols if c not in hot])
    return one_hot(df, hot) if hot else df


def encode_leftover(df: DataFrame, target: str | None = None) -> DataFrame:
    """Label codes for every text column still there, except the target."""
    return label_encode(df, text_names(df), target)


# Numeric transforms --------------------------------------------------------------

def _numbers(df: DataFrame, columns: Sequence[str], target: str | None = None) -> list[str]:
    return [c for c in present(df, columns, target) if is_feature(df.schema[c].dataType)]


def _double(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c if is_number(df.schema[name].dataType) else c.cast("int")).cast("double")


def fit_log(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The number columns without a negative value."""
    cols = _numbers(df, columns)
    if not cols:
        return []
    row = df.agg(*[F.min(_double(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"m{i}"] is None or row[f"m{i}"] >= 0]


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``log(1 + x)`` in place; columns with negative values are left alone."""
    cols = fit_log(df, columns)
    return df.withColumns({c: F.log1p(_double(df, c)) for c in cols}) if cols else df


def powers(df: DataFrame, columns: Sequence[str], degree: int = 2, target: str | None = None, max_columns: int | None = None,
           max_degree: int | None = None) -> DataFrame:
    """Add ``{column}_pow2`` to ``{column}_pow{degree}`` for the number columns.

    ``max_columns`` and ``max_degree`` bound them; by default nothing does.
    """
    cols = _numbers(df, columns, target)[:max_columns]
    top = degree if max_degree is None else min(degree, max_degree)
    made = {f"{c}_pow{d}": functools.reduce(lambda a, b: a * b, [_double(df, c)] * d) for c in cols for d in range(2, top + 1)}
    return df.withColumns(made) if made else df


def interactions(df: DataFrame, columns: Sequence[str], max_pairs: int | None = None) -> DataFrame:
    """Add ``{a}_x_{b}`` for the pairs of number columns, all unless ``max_pairs`` says how many."""
    pairs = itertools.islice(itertools.combinations(_numbers(df, columns), 2), max_pairs)
    made = {f"{a}_x_{b}": _double(df, a) * _double(df, b) for a, b in pairs}
    return df.withColumns(made) if made else df


# Dates ---------------------------------------------------------------------------

def fit_dates(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Columns of which at least half parse as a time, and whether each needs an hour part.

    The hour part is made when any hour is not 0 or any value did not parse.
    """
    cols = present(df, columns)
    if not cols:
        return {}
    tests = []
    parsed = df.select(*[time_parse(df.schema[c]).alias(f"t{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        t = F.col(f"t{i}")
        tests += [F.count(t).alias(f"n{i}"), F.count_if((F.hour(t) != 0) | t.isNull()).alias(f"h{i}")]
    row = parsed.agg(F.count(F.lit(1)).alias("rows"), *tests).first()
    rows = row["rows"]
    return {c: row[f"h{i}"] > 0 for i, c in enumerate(cols) if rows and row[f"n{i}"] / rows >= TIME_SHARE}


def apply_dates(df: DataFrame, parts: dict[str, bool]) -> DataFrame:
    for c, with_hour in parts.items():
        df = df.withColumn("_time_", time_parse(df.schema[c]))  # parsed once for all parts
        t = F.col("_time_")
        made = {
            f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t),
            f"{c}_dayofweek": F.weekday(t),
        }
        if with_hour:
            made[f"{c}_hour"] = F.hour(t)
        df = df.withColumns(made).drop(c, "_time_")
    return df


def date_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Year, month, day, weekday (Monday is 0) and, if needed, hour; the source goes."""
    return apply_dates(df, fit_dates(df, columns))


# Names and families ------------------------------------------------------------------

def title_group(name: Column) -> Column:
    """Group of the title in ``Surname, Title. Given``; Rare if unknown or absent."""
    title = F.trim(F.regexp_extract(name, TITLE_PATTERN, 1))
    group = F.lit(RARE_TITLE)
    for known, label in TITLE_GROUPS.items():
        group = F.when(title == known, F.lit(label)).otherwise(group)
    return group


def fit_titles(df: DataFrame, columns: Sequence[str], target: str | None = None) -> dict[str, list[str]]:
    """Text columns of which at least 70 % hold a title, with the title groups that occur."""
    cols = [c for c in present(df, columns, target) if is_text(df.schema[c].dataType)]
    if not cols:
        return {}
    tests = []
    for i, c in enumerate(cols):
        tests += [F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(TITLE_PATTERN)).alias(f"h{i}"),
                  F.collect_set(title_group(col(c))).alias(f"g{i}")]  # at most five groups
    row = df.agg(*tests).first()
    return {c: sorted(row[f"g{i}"]) for i, c in enumerate(cols)
            if row[f"n{i}"] and row[f"h{i}"] / row[f"n{i}"] >= NAME_SHARE}


def apply_titles(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    for c, found in groups.items():
        code = F.array_position(F.array(*[F.lit(g) for g in found]), title_group(F.coalesce(col(c), F.lit(""))))
        df = df.withColumn(f"{c}_title", (code - 1).cast("int")).drop(c)
    return df


def name_titles(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Replace name columns by the label code of their title group."""
    return apply_titles(df, fit_titles(df, columns, target))


def _named(df: DataFrame, names: Sequence[str], target: str | None) -> str | None:
    return next((c for c in df.columns if c != target and c.lower() in names), None)


def family_size(df: DataFrame, target: str | None = None) -> DataFrame:
    """Add ``FamilySize`` (siblings + parents + 1) and ``IsAlone`` when both counts exist."""
    siblings, parents = _named(df, SIBLING_NAMES, target), _named(df, PARENT_NAMES, target)
    if siblings is None or parents is None:
        return df
    return df.withColumn("FamilySize", col(siblings) + col(parents) + 1).withColumn(
        "IsAlone", F.coalesce(F.col("FamilySize") == 1, F.lit(False)).cast("int"))


# Feature matrix ------------------------------------------------------------------------

def feature_names(df: DataFrame, target: str, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_feature(f.dataType) and f.name != target and f.name not in skip]


def feature_matrix(df: DataFrame, target: str, skip: Sequence[str] = ()) -> DataFrame:
    """Number and flag columns as doubles with nulls as 0, next to the target and ``skip``."""
    made = [F.coalesce(_double(df, c), F.lit(0.0)).alias(c) for c in feature_names(df, target, skip)]
    return df.select(*[col(c) for c in skip], *made, col(target))


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)
