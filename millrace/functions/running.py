"""Running sums and positions in a global order, spread over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import col
from .storage import stored


def running_sum(
    df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over the rows earlier in the order, per ``by``.

    A window over the whole order would run in one task. Here Spark range-partitions
    the rows, the partition number is stored with them (so offsets stay valid if a
    task is rerun), each partition sums by itself, and the totals of earlier
    partitions, one small row per partition, are added.
    """
    by, order = list(by), list(order)
    keys = [col(c) for c in [*by, *order]]
    ranged = stored(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(col(v)).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *by,
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy("_part", *by).orderBy(*[col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1)
    out = ranged
    for v in values:
        out = out.withColumn(f"_w_{v}", F.coalesce(F.sum(col(v)).over(inside), F.lit(0)))
    out = out.join(F.broadcast(offsets), ["_part", *by])
    return out.select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"before_{v}") for v in values])
