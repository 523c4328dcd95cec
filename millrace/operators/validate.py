"""Finding faulty columns before preparation, and fixing them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import chunks, col, is_number, is_text, is_time
from ..functions.parsing import num_parse, text_number
from ..functions.value_counts import cardinality, countable, judged_cardinality
from ..sources.tables import file_order
from .profile import COUNT_CUTS

NUMERIC_SHARE = 0.9
ID_SHARE = 0.98
WIDE_TEXT_SHARE = 0.5
CLASS_LIMIT = 50
NULL_TARGET_SHARE = 0.5
FEW_VALUES = 20

# Fixed patterns: column names that suggest extractable structure (searched anywhere, any case).
STRUCTURED_NAMES = r"(date|time|year|month|day|timestamp)|(code|id|zip|postal|sku|isbn)"

DROPS = ("drop_id", "drop_high_cardinality", "drop_null_col")


def resolve_target(df: DataFrame, target: str | None = None, goal: str = "") -> str:
    """The named column, else the first one named in the goal text, else the last column."""
    if target in df.columns:
        return target
    text = goal.lower()
    return next((c for c in df.columns if c.lower() in text), df.columns[-1])


def infer_task(df: DataFrame, target: str) -> str:
    """Text or at most 20 distinct values means classification."""
    if is_text(df.schema[target].dataType):
        return "classification"
    few = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(FEW_VALUES + 1).count()
    return "classification" if few <= FEW_VALUES else "regression"


def target_null_share(df: DataFrame, target: str) -> DataFrame:
    """``null_share, too_many_nulls``."""
    share = F.avg(col(target).isNull().cast("int"))
    return df.agg(share.alias("null_share"), (share > NULL_TARGET_SHARE).alias("too_many_nulls"))


def class_count(df: DataFrame, target: str) -> DataFrame:
    """``n_classes, too_many_classes``."""
    n = cardinality(df, [target])
    return n.select(F.col("n_unique").alias("n_classes"),
                    (F.col("n_unique") > CLASS_LIMIT).alias("too_many_classes"))


def numeric_text(df: DataFrame, target: str | None = None) -> DataFrame:
    """``column, parsed_share, is_numeric_text`` of text columns, over all non-null values."""
    cols = [f.name for f in df.schema.fields if is_text(f.dataType) and f.name != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, parsed_share double, is_numeric_text boolean")
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(text_number(col(c))).alias(f"p{i}"), F.count(col(c)).alias(f"n{i}"))])
    cells = [F.struct(F.lit(c).alias("column"),
                      (F.col(f"p{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("parsed_share"))
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells))).withColumn(
        "is_numeric_text", F.coalesce(F.col("parsed_share") > NUMERIC_SHARE, F.lit(False)))


# Order test ---------------------------------------------------------------------

def _coarse_survivors(df: DataFrame, order: str, columns: list[str], blocks: int = 1024) -> list[str]:
    """Columns whose value ranges already overlap the wrong way between blocks of the order
    column cannot be in order; this map-side test spares them the sort."""
    o = num_parse(df.schema[order])
    span = df.agg(F.min(o).alias("lo"), F.max(o).alias("hi")).first()
    if span["lo"] is None or span["lo"] == span["hi"]:
        return columns
    block = F.floor((o - F.lit(span["lo"])) / F.lit(span["hi"] - span["lo"]) * blocks).alias("b")
    parsed = {c: num_parse(df.schema[c]) for c in columns}
    ranges = df.groupBy(block).agg(*[
        e for i, c in enumerate(columns)
        for e in (F.min(parsed[c]).alias(f"lo{i}"), F.max(parsed[c]).alias(f"hi{i}"))
    ]).orderBy("b").collect()
    alive = []
    for i, c in enumerate(columns):
        top, good = None, True
        for r in ranges:
            if r[f"lo{i}"] is None:
                continue
            good = good and (top is None or top <= r[f"lo{i}"])
            top = r[f"hi{i}"]
        if good:
            alive.append(c)
    return alive


def _order_value(field: T.StructField):
    """What the order test compares: whole numbers and decimals as they are, the rest as ``num_parse``."""
    exact = isinstance(field.dataType, (T.IntegralType, T.DecimalType))
    return col(field.name) if exact else num_parse(field)


def _partition_summary(columns: list[str], schema: pa.Schema):
    """Per partition: for each column its first and last value and its falls, compared in the column's type."""
    def run(batches):
        first, last, falls = [None] * len(columns), [None] * len(columns), [0] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                v = batch.column(i).drop_null()
                if not len(v):
                    continue
                falls[i] += pc.sum(pc.less(v[1:], v[:-1])).as_py() or 0
                falls[i] += last[i] is not None and v[0].as_py() < last[i]
                first[i] = v[0].as_py() if first[i] is None else first[i]
                last[i] = v[-1].as_py()
        values = [TaskContext.get().partitionId(), *[x for i in range(len(columns)) for x in (first[i], last[i], int(falls[i]))]]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)
    return run


def order_falls(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> dict[str, int]:
    """How often each column's number falls from one non-null row to the next in the given order.

    Spark range-partitions and sorts only the order and candidate columns; each
    partition reports its first and last value, and these ends are compared.
    Rows with equal order values are taken in the order of the candidates, so a
    value that fills much of the order column can still be split.
    """
    columns, order_by = list(columns), list(order_by)
    parsed = df.select(*[col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
                       *[_order_value(df.schema[c]).alias(f"_c{i}") for i, c in enumerate(columns)])
    keys = [F.col(f"_o{i}") for i in range(len(order_by))] + [F.col(f"_c{i}") for i in range(len(columns))]
    parts = parsed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[F.col(f"_c{i}") for i in range(len(columns))])
    kinds = [parts.schema[f"_c{i}"].dataType for i in range(len(columns))]
    schema = T.StructType([T.StructField("part", T.IntegerType()), *[
        T.StructField(f"{n}{i}", kind) for i, own in enumerate(kinds) for n, kind in (("first", own), ("last", own), ("falls", T.LongType()))]])
    ends = parts.mapInArrow(_partition_summary(columns, to_arrow_schema(schema)), schema)
    # One row per partition: joining the ends is a window of that length.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.select(*[(F.col(f"falls{i}") + F.coalesce((F.col(f"first{i}") < F.last(f"last{i}", True).over(before)).cast("bigint"), F.lit(0)))
                          .alias(f"n{i}") for i in range(len(columns))])
    row = steps.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    return {c: row[f"n{i}"] or 0 for i, c in enumerate(columns)}


def column_counts(df: DataFrame) -> tuple[int, dict[str, int], dict[str, int]]:
    """Rows, non-null values per column, and per column how many parse as a number, in one scan."""
    n_rows, filled, parsed = 0, {}, {}
    for part in chunks(df.schema.fields, 100):
        measures = [F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(part)]
        measures += [F.count(num_parse(f)).alias(f"p{i}") for i, f in enumerate(part)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first()
        n_rows = row["rows"]
        filled.update({f.name: row[f"n{i}"] for i, f in enumerate(part)})
        parsed.update({f.name: row[f"p{i}"] for i, f in enumerate(part)})
    return n_rows, filled, parsed


def _ids(df: DataFrame, near: list[str], parsed: dict[str, int], order_by: Sequence[str], text_ids: bool) -> list[str]:
    found = {c for c in near if parsed[c] == 0} if text_ids else set()
    ordered = [c for c in near if parsed[c] > 0]
    if ordered and not order_by:  # the rows of files have an order of their own
        places = file_order(df)
        if places is None:
            ordered = []
        else:
            order_by = unique_names([*df.columns, *[f"_place_{i}" for i in range(len(places))]])[len(df.columns):]
            df = df.select("*", *[p.alias(c) for p, c in zip(places, order_by)])
    if ordered:
        lead = df.schema[order_by[0]].dataType
        if is_number(lead) or is_time(lead):
            ordered = _coarse_survivors(df, order_by[0], ordered)
    if ordered:
        found |= {c for c, n in order_falls(df, ordered, order_by).items() if n == 0}
    return [c for c in near if c in found]


def id_columns(df: DataFrame, target: str | None = None, order_by: Sequence[str] = (),
               text_ids: bool = True) -> list[str]:
    """Columns that are near-unique and never fall in row order.

    Without ``order_by`` the order is that of the files ``df`` is read from; if it comes from elsewhere (a join, a sort,
    rows of the session), the order must be named, or no number column is tested.
    Text that never parses as a number has nothing to fall, so near-unique text
    is an ID at once (``text_ids=False`` turns this off).
    """
    n_rows, _, parsed = column_counts(df)
    unique = {r["column"]: r["n_unique"] for r in cardinality(df).collect()}
    counts = {c: unique[c] for c in countable(df)}
    near = [c for c, n in counts.items() if c != target and n / max(n_rows, 1) > ID_SHARE]
    return _ids(df, near, parsed, order_by, text_ids)


# Whole report ------------------------------------------------------------------------

REPORT_SCHEMA = "column string, check string, action string, detail string"


@dataclass
class Validation:
    """Issues as ``(column, check, action, detail)`` and the fix per column."""

    issues: list[tuple[str, str, str | None, str]] = field(default_factory=list)
    fixes: dict[str, str] = field(default_factory=dict)
    n_unique: dict[str, int] = field(default_factory=dict)

    @property
    def severity(self) -> str:
        if any(check == "target_missing" for _, check, _, _ in self.issues):
            return "error"
        return "warning" if self.issues else "ok"

    def table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.issues, REPORT_SCHEMA)


def unique_names(names: Sequence[str]) -> list[str]:
    """The names with a position behind those used before."""
    out: list[str] = []
    for name in names:
        made, k = name, 1
        while made.lower() in {x.lower() for x in out} or (k > 1 and made in names):
            k += 1
            made = f"{name}.{k}"
        out.append(made)
    return out


def validate(df: DataFrame, target: str, task: str = "regression", order_by: Sequence[str] = (),
             text_ids: bool = True, exact: bool = True, wide_text_rows: int = 0) -> Validation:
    """Check the target, text numbers, IDs, near-unique text, empty and repeated columns.

    Distinct counts are exact, or without ``exact`` only where they decide something and
    estimates elsewhere. Near-unique text is looked for from ``wide_text_rows`` rows on.
    Columns that share a name are told apart by position, as ``name``, ``name.2``, ...
    """
    report = Validation()
    names = list(df.columns)
    df = df.toDF(*unique_names(names))

    def note(column: str, check: str, action: str | None, detail: str) -> None:
        report.issues.append((column, check, action, detail))
        if action:
            report.fixes[column] = action

    n_rows, filled, parsed = column_counts(df)
    if exact:
        n_unique = {r["column"]: r["n_unique"] for r in cardinality(df).collect()}
    else:
        n_unique = judged_cardinality(df, (*COUNT_CUTS, WIDE_TEXT_SHARE * n_rows, ID_SHARE * n_rows))
    report.n_unique = n_unique
    text = [f.name for f in df.schema.fields if is_text(f.dataType) and f.name != target]

    if target not in df.columns:
        note(target, "target_missing", None, "target column is not in the table")
    else:
        share = 1 - filled[target] / n_rows if n_rows else 0.0
        if share > NULL_TARGET_SHARE:
            note(target, "target_nulls", None, f"{share:.1%} of the target is missing")
        if task == "classification" and n_unique.get(target, 0) > CLASS_LIMIT:
            note(target, "target_classes", None, f"{n_unique[target]} classes; consider regression")

    for c in text:
        if filled[c] and parsed[c] / filled[c] > NUMERIC_SHARE:
            note(c, "numeric_text", "convert_to_numeric", f"{parsed[c] / filled[c]:.1%} of values are numbers")

    near = [c for c in countable(df) if c != target and c not in report.fixes
            and n_unique[c] / max(n_rows, 1) > ID_SHARE]
    for c in _ids(df, near, parsed, order_by, text_ids):
        note(c, "id", "drop_id", f"{n_unique[c]} distinct values, never falling")

    if n_rows >= wide_text_rows:
        for c in text:
            if c not in report.fixes and n_unique[c] / max(n_rows, 1) > WIDE_TEXT_SHARE:
                keep = re.search(STRUCTURED_NAMES, c, re.IGNORECASE)
                note(c, "high_cardinality_kept" if keep else "high_cardinality",
                     None if keep else "drop_high_cardinality", f"{n_unique[c]} distinct values")

    for c in df.columns:
        if filled[c] == 0:
            note(c, "all_null", "drop_null_col", "every value is missing")
    for c in dict.fromkeys(c for c in names if names.count(c) > 1):
        note(c, "duplicate_name", None, "the name is used by several columns")
    return report


def apply_fixes(df: DataFrame, fixes: dict[str, str]) -> DataFrame:
    """Cast flagged text to numbers (bad text becomes null) and drop flagged columns."""
    kept = []
    for f in df.schema.fields:
        action = fixes.get(f.name)
        if action in DROPS:
            continue
        parse = action == "convert_to_numeric" and not isinstance(f.dataType, T.NumericType)
        kept.append(num_parse(f).alias(f.name) if parse else col(f.name))
    return df.select(*kept)
