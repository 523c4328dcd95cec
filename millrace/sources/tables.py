"""Reading CSV, JSON and Parquet tables, and looking at them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import chunks, col, null_nan
from ..functions.parsing import NUMBER_PATTERN, text_number
from ..functions.storage import shared_dir, stored
from .records import csv_grammar, cut, json_grammar, spans_lines

# Fixed list: the texts a CSV reader takes as a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER_PATTERN = r"^\s*[+-]?\d{1,38}\s*$"
FLAG_PATTERN = r"^(True|False|TRUE|FALSE|true|false)$"
SUFFIXES = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def _infer(df: DataFrame) -> DataFrame:
    """Cast all-text columns to the narrowest type every value fits, in one pass."""
    kinds: dict[str, str] = {}
    for part in chunks(df.columns, 50):
        tests = []
        for i, c in enumerate(part):
            tests += [
                F.count(col(c)).alias(f"n{i}"),
                F.count_if(col(c).rlike(INTEGER_PATTERN)).alias(f"i{i}"),
                F.count_if(col(c).rlike(INTEGER_PATTERN) & F.trim(col(c)).try_cast("bigint").isNotNull()).alias(f"l{i}"),
                F.count_if(col(c).rlike(NUMBER_PATTERN)).alias(f"d{i}"),
                F.count_if(col(c).rlike(FLAG_PATTERN)).alias(f"b{i}"),
            ]
        row = df.agg(*tests).first()
        for i, c in enumerate(part):
            n = row[f"n{i}"]
            hits = {"bigint": row[f"l{i}"], "decimal(38,0)": row[f"i{i}"], "double": row[f"d{i}"], "boolean": row[f"b{i}"]}
            kinds[c] = next((k for k, hit in hits.items() if n and hit == n), "double" if not n else "string")

    def typed(c: str) -> Column:
        if kinds[c] == "double":
            return text_number(col(c)).alias(c)
        if kinds[c] == "string":
            return col(c)
        return F.trim(col(c)).try_cast(kinds[c]).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], infer: bool = True, **options) -> DataFrame:
    """CSV with a header. Missing-value texts become NULL before types are inferred.

    Line breaks in quoted fields are kept. Where there are any, the records are cut in parallel and the columns stored
    once as texts; else the files are read as they are. With ``multiLine``, ``header`` or ``encoding`` given, Spark's reader
    alone decides.
    """
    settings = {"header": True, "quote": '"', "escape": '"', "inferSchema": False, **options}
    raw = None
    if not {"multiLine", "header", "encoding", "lineSep", "comment"} & set(options) and settings["escape"] == settings["quote"]:
        grammar = csv_grammar(options.get("sep", options.get("delimiter", ",")), settings["quote"])
        tables, spanning = spans_lines(spark, path, grammar)
        raw = _cut_csv(spark, path, grammar, tables, settings) if spanning else None
    if raw is None:
        raw = spark.read.options(**settings).csv(path)
    cleaned = raw.select(*[
        F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    return _infer(cleaned) if infer else cleaned


def _cut_csv(spark: SparkSession, path: str | Sequence[str], grammar, tables: DataFrame, settings: dict) -> DataFrame:
    """All columns as texts. The first record of each file is its header; the first file's names the columns."""
    options = {k: str(v) for k, v in settings.items() if k not in ("header", "inferSchema")}
    records = cut(spark, path, grammar, tables).withColumn("text", F.regexp_replace("text", r"\r?\n\z", ""))
    records = stored(records, "records")
    heads = records.groupBy("file").agg(F.min(F.struct("block", "place", "text")).alias("head"))
    first = heads.orderBy("file").first()
    if first is None:
        return spark.read.options(**settings).csv(path)
    header = first["head"]["text"].removeprefix("\ufeff")
    # the header's columns as Spark's reader names them, doubles and blanks included
    names = spark.read.options(**settings).csv(spark.sparkContext.parallelize([header], 1)).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    if heads.filter((F.col("head.block") > 0) | (F.col("head.place") > 0)).isEmpty():
        body = records.filter((F.col("block") > 0) | (F.col("place") > 0))
    else:  # a header longer than a block, or blocks of blank lines; stored, as a join would hide the order of the rows
        body = records.join(heads.select("file", "head.block", "head.place"), ["file", "block", "place"], "left_anti")
        body = stored(body.orderBy("file", "block", "place"), "records")
    parsed = body.select(F.from_csv("text", schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])


def read_json(spark: SparkSession, path: str | Sequence[str], lines: bool = False, **options) -> DataFrame:
    """An array of records (or records one after the other) per file, or one record per line with ``lines=True``.

    Arrays are cut into lines in parallel, however long a file is, and stored once; with ``multiLine`` or ``encoding`` given,
    Spark's reader alone decides.
    """
    if lines or {"multiLine", "encoding", "lineSep"} & set(options):
        return null_nan(spark.read.options(**{"multiLine": not lines, **options}).json(path))
    records = cut(spark, path, json_grammar()).select(F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    # what is between records and behind the last one
    records = records.select(F.regexp_replace("text", r"\A[\ufeff\s,\[]+", "").alias("text")).filter(~F.col("text").rlike(r"\A[\s\]}]*\z"))
    folder = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    records.write.text(folder)
    return null_nan(spark.read.options(**options).json(folder))


def read_parquet(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    return null_nan(spark.read.options(**options).parquet(path))


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read ``path`` by format name, or by its suffix."""
    name = path.rstrip("/").lower()
    fmt = fmt or next((f for s, f in SUFFIXES.items() if name.endswith(s)), None)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt == "jsonl":
        return read_json(spark, path, lines=True, **options)
    if fmt == "parquet":
        return read_parquet(spark, path, **options)
    raise ValueError(f"cannot tell the format of {path!r}; pass fmt='csv', 'json' or 'parquet'")


def file_order(df: DataFrame) -> list[Column] | None:
    """Columns whose order is that of the rows in their files, for a table that is a scan of files with no more than
    columns and filters on top; else None.

    Parquet numbers its rows; in text files a row's place is its block and its turn in there. Records that were cut in
    parallel are stored in the order of their files.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return None
        plan = plan.children().apply(0)
    for places in ([F.col("_metadata.row_index")], [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]):
        order = [F.col("_metadata.file_path"), *places]
        try:
            df.select(*order)
        except AnalysisException:
            continue
        return order
    return None


def preview(df: DataFrame, order_by: Sequence[str] = (), n: int = 5) -> DataFrame:
    """The first ``n`` rows as text, blanks for missing values; by default in the order of the files, if df is read from some."""
    order = [col(c) for c in order_by] or file_order(df)
    shown = [F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    if not order:
        return df.limit(n).select(*shown)
    keys = [o.alias(f"_order_{i}") for i, o in enumerate(order)]
    names = [f"_order_{i}" for i in range(len(order))]
    return df.select(*shown, *keys).orderBy(*names).limit(n).drop(*names)


def preview_schema(df: DataFrame) -> DataFrame:
    """``column, dtype, n_rows, n_columns``: the header of the preview."""
    fields = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.inline(fields), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
