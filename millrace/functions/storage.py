"""Durable intermediate tables in the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .columns import col


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session may fall back to a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(base)
    return base


def stored(df: DataFrame, label: str, partition_by: Sequence[str] = (), read_as: dict[str, T.DataType] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors; being columnar,
    later passes still read only the columns they need, and a filter on a
    ``partition_by`` column skips whole files. ``read_as`` gives columns another type
    with the same layout.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    schema = T.StructType([T.StructField(f.name, (read_as or {}).get(f.name, f.dataType), f.nullable, f.metadata) for f in df.schema])
    return spark.read.schema(schema).parquet(path).select(*[col(c) for c in df.columns])
