"""Exact order statistics and quantiles without a global sort.

``percentile`` keeps every distinct value of a column in one task, which fails
on large columns. Here a histogram is refined instead: each pass counts values
per bucket of a monotone scale (map-side, at most a few thousand groups per
target), finds the bucket that holds the wanted rank, and the next pass looks
only inside it. Buckets carry the smallest and largest value seen in them, so
the next bracket is a closed interval of real values; a pass ends a target as
soon as both agree. A value held by a third of all rows is one bucket.

The first scale is logarithmic (64 steps per power of two), which separates
signs and magnitudes; the later ones are linear with 4096 steps. Large integers,
such as hashes, start linear between their known ends. A double has
52 mantissa bits, so a handful of passes settles any input exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import chunks, col, null_nan

STEPS = 4096
OCTAVE_STEPS = 64
OCTAVE_SHIFT = 1100 * OCTAVE_STEPS
MAX_INLINE_RANGES = 32
WIDE = 50  # columns taken together


EXACT_DOUBLE = 2**53
LONG_SPAN = 2**63


def _family(dtype: T.DataType, low: object, high: object) -> str:
    """Type the values of a column are compared in, exact for the range it holds."""
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if isinstance(dtype, T.LongType) and low is not None and max(abs(low), abs(high)) > EXACT_DOUBLE:
        return "bigint"
    return "double"


def _octave(v: Column) -> Column:
    x = v.cast("double")
    step = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * OCTAVE_STEPS) + OCTAVE_SHIFT
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("bigint") * step)


def _linear(v: Column, lo: Column, hi: Column) -> Column:
    share = (v - lo).cast("double") / (hi - lo).cast("double")
    return F.floor(share * STEPS)


def _long(df: DataFrame, columns: dict[int, str], family: str, by: str | None,
          spans: dict[int, list[tuple]] | None = None) -> DataFrame:
    """One row ``(g, cid, v)`` per non-null cell of the given columns, inside ``spans`` if given.

    Only columns that still have an open target are read.
    """
    cells = []
    for cid, name in columns.items():
        v = col(name).cast(family)
        if spans is not None:
            inside = F.lit(False)
            for lo, hi in dict.fromkeys(spans[cid]):
                inside = inside | v.between(F.lit(lo).cast(family), F.lit(hi).cast(family))
            v = F.when(inside, v)
        cells.append(F.struct(F.lit(cid).alias("cid"), v.alias("v")))
    group = (col(by) if by else F.lit(0)).alias("g")
    out = df.select(group, F.inline(F.array(*cells))).where("v IS NOT NULL")
    return out.where("g IS NOT NULL") if by else out


def _locate(hist: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket holding each wanted rank, and the rank inside that bucket.

    The window runs over the buckets of one target only, whose number the
    scale bounds, never over rows.
    """
    w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("n").over(w))
    hit = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
    return (
        cum.join(F.broadcast(wanted), keys).where(hit)
        .select("tid", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )


def _targets(spark, wanted: list[tuple], group_type: T.DataType) -> DataFrame:
    return spark.createDataFrame(wanted, T.StructType([
        T.StructField("tid", T.IntegerType()), T.StructField("g", group_type),
        T.StructField("cid", T.IntegerType()), T.StructField("rank", T.LongType())]))


def _refine(df: DataFrame, members: list[str], wanted: list[tuple], by: str | None, group_type: T.DataType,
            family: str, known: dict[tuple, tuple] | None = None) -> dict:
    """``wanted`` holds ``(tid, g, cid, rank)``; returns ``tid -> value``.

    With the ``known`` smallest and largest value per ``(g, cid)`` the linear
    passes start at once.
    """
    spark = df.sparkSession
    kind = T._parse_datatype_string(family)
    stats = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    place = {tid: (g, cid) for tid, g, cid, _ in wanted}
    if known:
        rows = [dict(zip(("tid", "rank", "lo", "hi"), (tid, rank, *known[(g, cid)]))) for tid, g, cid, rank in wanted]
    else:
        long = _long(df, dict(enumerate(members)), family, by)
        hist = long.groupBy("g", "cid", _octave(F.col("v")).alias("b")).agg(*stats)
        rows = _locate(hist, _targets(spark, wanted, group_type), ["g", "cid"]).collect()
    found: dict[int, object] = {}
    while True:
        found.update({r["tid"]: r["lo"] for r in rows if r["lo"] == r["hi"]})
        open_rows = [r for r in rows if r["lo"] != r["hi"]]
        if not open_rows:
            return found
        spans: dict[tuple, int] = {}
        targets, ranges = [], {}
        for r in open_rows:
            g, cid = place[r["tid"]]
            key = (g, cid, r["lo"], r["hi"])
            ranges.setdefault(cid, []).append((r["lo"], r["hi"]))
            targets.append((r["tid"], spans.setdefault(key, len(spans)), r["rank"]))
        span_frame = spark.createDataFrame(
            [(sid, *key) for key, sid in spans.items()],
            T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("g", group_type),
                          T.StructField("cid", T.IntegerType()),
                          T.StructField("slo", kind), T.StructField("shi", kind)]))
        # Few ranges become a condition on the scan; with many groups the join alone decides.
        limits = ranges if max(map(len, ranges.values())) <= MAX_INLINE_RANGES else None
        long = _long(df, {cid: members[cid] for cid in ranges}, family, by, limits)
        inside = long.join(F.broadcast(span_frame), ["g", "cid"]).where("v >= slo AND v <= shi")
        hist = inside.groupBy("sid", _linear(F.col("v"), F.col("slo"), F.col("shi")).alias("b")).agg(*stats)
        frame = spark.createDataFrame(targets, "tid int, sid int, rank bigint")
        rows = _locate(hist, frame, ["sid"]).collect()


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Callable[[int], Sequence[int]],
    by: str | None = None,
) -> dict[tuple, tuple[int, list]]:
    """``(group, column) -> (count, values at ranks(count))`` over the values that are neither null nor NaN.

    Ranks count from 0. ``by`` must have a bounded number of values (classes,
    chart levels): the result and the brackets grow with it, the data does not
    move. Without ``by`` the group is 0.
    """
    columns = list(columns)
    df = null_nan(df.select(*[col(c) for c in dict.fromkeys([*columns, *([by] if by else [])])]))
    counts = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    longs = [c for c in columns if isinstance(df.schema[c].dataType, T.LongType)]
    counts += [f(col(c)).alias(f"{n}{i}") for i, c in enumerate(longs) for n, f in (("lo", F.min), ("hi", F.max))]
    if by:
        counted = df.where(col(by).isNotNull()).groupBy(col(by).alias("g")).agg(*counts)
    else:
        counted = df.agg(F.lit(0).alias("g"), *counts)
    counted = counted.collect()
    sizes = {r["g"]: [r[f"n{i}"] for i in range(len(columns))] for r in counted}
    ends = {c: [v for r in counted for v in (r[f"lo{i}"], r[f"hi{i}"]) if v is not None] for i, c in enumerate(longs)}
    group_type = df.schema[by].dataType if by else T.IntegerType()

    families: dict[str, list[str]] = {}
    for c in columns:
        low, high = (min(ends[c]), max(ends[c])) if ends.get(c) else (None, None)
        families.setdefault(_family(df.schema[c].dataType, low, high), []).append(c)
    result: dict[tuple, tuple[int, list]] = {}
    for family, members in families.items():
        wanted, slots = [], {}
        for g, counts in sizes.items():
            for cid, c in enumerate(members):
                n = counts[columns.index(c)]
                if n == 0:
                    result[(g, c)] = (0, [])
                    continue
                picks = list(ranks(n))
                slots[(g, c)] = (n, picks)
                for r in dict.fromkeys(picks):
                    wanted.append((len(wanted), g, cid, r))
        if not wanted:
            continue
        known = None
        if family == "bigint":
            known = {(r["g"], cid): (r[f"lo{longs.index(c)}"], r[f"hi{longs.index(c)}"])
                     for r in counted for cid, c in enumerate(members) if (r["g"], c) in slots}
            if any(hi - lo >= LONG_SPAN for lo, hi in known.values()):
                known = None  # the difference of two values would overflow
        values = _refine(df, members, wanted, by, group_type, family, known)
        restore = int if family == "double" else lambda v: v
        at = {(g, cid, r): restore(values[tid]) if members[cid] in longs else values[tid] for tid, g, cid, r in wanted}
        for (g, c), (n, picks) in slots.items():
            result[(g, c)] = (n, [at[(g, members.index(c), r)] for r in picks])
    return result


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: str | None = None,
) -> dict:
    """Exact interpolated quantiles: ``column -> [values]``, or ``(group, column) -> [values]``.

    A column without values gives ``[None, ...]``.
    """
    def ranks(n: int) -> list[int]:
        out = []
        for p in probs:
            at = (n - 1) * p
            out += [math.floor(at), math.ceil(at)]
        return out

    out = {}
    found = {}
    for part in chunks(list(columns), WIDE):
        found |= order_statistics(df, part, ranks, by)
    for (g, c), (n, vals) in found.items():
        qs = []
        for i, p in enumerate(probs):
            if n == 0:
                qs.append(None)
                continue
            at = (n - 1) * p
            low, high = float(vals[2 * i]), float(vals[2 * i + 1])
            qs.append(low + (high - low) * (at - math.floor(at)) if low != high else low)
        out[(g, c) if by else c] = qs
    return out
