"""Running a function over every text of a table in Arrow batches, one document at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.columns import col

#: Bytes of output gathered before a batch is passed on.
FLUSH_BYTES = 4 << 20
#: What Spark gathers of texts or sets before it passes them on: bytes sent to Python, and rows decoded from Parquet.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hold a few MB of texts or sets at a time, not all those of their task.

    Each task holds them three times: decoded in the JVM's heap, as Arrow buffers beside it, which its allocator keeps for
    good, and in its Python worker. Smaller limits of the session stay; its settings are put back at the end.
    """
    before = {key: spark.conf.get(key) for key in SMALL}
    try:
        for key, most in SMALL.items():
            number, unit = re.match(r"(\d+)\s*([kmgtp]?)", before[key].strip().lower()).groups()
            if int(number) << 10 * " kmgtp".index(unit or " ") > most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def per_text(docs: DataFrame, make: Callable[[], Callable[[bytes], tuple]], fields: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: ``id`` and the ``fields`` that ``make()(utf-8 bytes)`` returns.

    ``make`` runs once per task. A null text counts as empty. Only the id and the text reach Python.
    """
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        each = make()
        for batch in batches:
            yield from rows_to_batches(((i, each(t.as_py() or b"")) for i, t in zip(batch.column(0), batch.column(1))), types)

    types = arrow_types(schema)
    return source.mapInArrow(run, schema)


def release() -> None:
    """Give back what earlier tasks of a reused worker, or the reading of large files, left in this process's pools.

    Called where a task starts: what a worker holds from other stages adds to what the next one needs.
    """
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def arrow_types(schema: T.StructType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]


def rows_to_batches(rows: Iterator[tuple[Any, tuple]], types: list[tuple[str, pa.DataType]], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of (id, values) rows; large values are passed on early."""
    schema, ids, values, held = pa.schema(types), [], [], 0
    for i, row in rows:
        ids.append(i)
        values.append(row)
        held += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in row if isinstance(v, (bytes, str, np.ndarray)))
        if len(ids) >= size or held >= FLUSH_BYTES:
            yield _batch(ids, values, schema)
            ids, values, held = [], [], 0
    if ids:
        yield _batch(ids, values, schema)


def _batch(ids: list, values: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    first = pa.array([i.as_py() if isinstance(i, pa.Scalar) else i for i in ids], schema.field(0).type)
    rest = [pa.array([v[k] for v in values], schema.field(k + 1).type) for k in range(len(schema) - 1)]
    return pa.RecordBatch.from_arrays([first, *rest], schema=schema)
