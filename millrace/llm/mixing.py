"""Mixing sources to target weights by entropy balancing.

Every document gets the rate closest to 1 in entropy such that each source's tokens meet its target and no rate is
above ``cap``. The solution is ``min(cap, exp(lam * size))`` with one multiplier per source; the multipliers solve a
convex dual by Newton steps. Documents of one source and size share a rate, so the steps run over a histogram
``(source, size, documents)``, not over documents. Rates become whole copies by hash rounding with one threshold per
source, refined over bins until the copies' tokens meet the target to within the documents of one very fine bin.

Everything is DataFrame functions; sums are exact decimals, so reruns agree bit for bit. Defined cases: a null text
has size 0; a null source is a source of its own, after all others; documents of size 0 get no words; equal ids get
equal copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.storage import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Newton stops when every source's tokens are this close to the target, as a share of it.
CLOSE = 1e-7
ROUNDS = 60
#: Hash bins of a refinement step (as bits), and steps.
BIN_BITS, BIN_STEPS = 10, 3
#: Ranges of extra copies of a source: how often a document in the way is passed over.
FILLS = 3
WORD = r"[^\x20\x09-\x0D]+"

_EXACT = "decimal(38,6)"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: Column) -> DataFrame:
    """id, source, size: the words of every whole text."""
    words = F.regexp_count(col(text_col), F.lit(WORD)).cast("bigint")
    return docs.select(col(id_col).alias("id"), col(source_col).alias("source"),
                       F.coalesce(words, F.lit(0).cast("bigint")).alias("size"), *more)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in code point order, null last, take the weights in turn. Targets stop at ``cap`` times the source; the
    excess is shared again by weight until none is above. One row per source: small next to the documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = stored(sources.withColumn("weight", weight), "source-weights")
    limit = cap * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:
        open_weight, taken = table.filter(~full).agg(F.sum("weight")).first()[0], table.filter(full).agg(F.sum(limit)).first()[0]
        if not open_weight:
            break
        level = (share * total - float(taken or 0)) / open_weight
        above = full | (F.col("weight") * F.lit(level) > limit)
        if table.filter(above & ~full).isEmpty():
            break
        full = above
    return table.select("source", "source_size", F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _exact_sum(value: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows."""
    return F.sum(value.cast(_EXACT)).cast("double")


def _rate(cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(50.0))))


def balance(histogram: DataFrame, targets: DataFrame, cap: float = CAP, close: float = CLOSE, rounds: int = ROUNDS) -> DataFrame:
    """source, unit, lam, full: the dual's solution. ``histogram``: source, size, n.

    Newton steps kept between the bounds seen so far; a step that leaves them is halved into them. ``full`` sources
    need every copy and have no finite multiplier. A dual that isn't solved in ``rounds`` steps raises.
    """
    unit = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    state = (targets.alias("t").join(unit.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")))
             .select("t.source", "target", F.greatest("unit", F.lit(1.0)).alias("unit"),
                     (F.col("target") >= cap * F.col("source_size")).alias("full"),
                     F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
             .withColumn("done", F.col("full") | (F.col("target") <= 0)))
    state = stored(state, "balance")
    x = F.col("size") / F.col("unit")
    for _ in range(rounds):
        if state.filter(~F.col("done")).isEmpty():
            return state
        rate, here = _rate(cap), F.col("n") * F.col("size")
        sums = (histogram.alias("h").join(state.filter(~F.col("done")).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
                .groupBy(F.col("h.source").alias("source"))
                .agg(_exact_sum(here * rate).alias("got"), _exact_sum(F.when(rate < cap, here * rate * x).otherwise(0.0)).alias("slope")))
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.nullif(F.col("slope"), F.lit(0.0))
        outside = newton.isNull() | (newton <= F.col("low")) | (newton >= F.col("high"))
        wide = F.when(F.col("low").isNull(), F.least(F.col("high") * 2, F.col("high") - 1)).when(F.col("high").isNull(), F.greatest(F.col("low") * 2, F.col("low") + 1)).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.abs(F.col("got") - F.col("target")) <= close * F.col("target")
        step = (state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left")
                .select("s.source", "target", "unit", "full", "lam", "low", "high", "done", "got", "slope")
                .withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high), "done": F.col("done") | near})
                .withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.when(outside, wide).otherwise(newton))))
        state = stored(step.drop("got", "slope"), "balance")
    if state.filter(~F.col("done")).isEmpty():
        return state
    raise RuntimeError(f"the dual did not converge in {rounds} rounds")


def _unit_hash(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that only depends on the key."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def _rounded(rated: DataFrame, targets: DataFrame, cap: int, bits: int = BIN_BITS, steps: int = BIN_STEPS, rounds: int = FILLS) -> DataFrame:
    """source, cuts: documents whose ``order`` lies in one of the ranges take their extra copy.

    ``order`` is the hash less the rate's fraction: hashes alone would add the extra copies whose order is below 0.
    The first range ends where the tokens would pass the target; the next ones pass over the document in the way and
    go on with what still fits.
    """
    base = F.floor(F.col("rate"))
    ranges = F.array().cast("array<struct<low double, high double>>")
    wants = (rated.groupBy("source").agg(F.sum(base * F.col("size")).alias("sure")).alias("b")
             .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
             .select("t.source", (F.col("target") - F.col("sure")).alias("want"), F.lit(-1.0).alias("low"), F.lit(-1.0).alias("cut"), ranges.alias("cuts")))
    state = stored(wants, "cuts")
    extra = rated.filter((F.col("rate") < cap) & (F.col("size") > 0)).select("source", "size", "order")
    for turn in range(rounds):
        width = 2.0
        for step in range(steps):
            width /= 1 << bits
            last = step == steps - 1 and turn == rounds - 1
            slack = F.col("r.size") / 2 if last else F.lit(0.0)  # the last bin may pass the target if that is nearer
            place = F.floor((F.col("order") - F.col("cut")) / F.lit(width))
            bins = (extra.alias("e").join(state.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")))
                    .select("s.source", "size", place.alias("bin")).filter(F.col("bin").between(0, (1 << bits) - 1))
                    .groupBy("source", "bin").agg(F.sum("size").alias("size")))
            running = F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
            fits = (bins.withColumn("upto", running).alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
                    .withColumn("fits", F.col("upto") - slack <= F.col("want")).groupBy(F.col("s.source").alias("source"))
                    .agg(F.min(F.expr("if(fits, null, bin)")).alias("bin"), F.max(F.expr("if(fits, upto, 0)")).alias("upto")))
            state = stored(state.alias("s").join(fits.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left").select(
                "s.source", (F.col("want") - F.coalesce("upto", F.lit(0))).alias("want"), "low",
                (F.col("cut") + F.coalesce("bin", F.lit(1 << bits)) * F.lit(width)).alias("cut"), "cuts"), "cuts")  # up to what is in the way
        state = state.select("source", "want", (F.col("cut") + F.lit(width)).alias("low"), (F.col("cut") + F.lit(width)).alias("cut"),
                             F.concat("cuts", F.array(F.struct("low", F.col("cut").alias("high")))).alias("cuts"))
    return state.select("source", "cuts")


def _rated(rows: DataFrame, known: DataFrame, cap: int, seed: int) -> DataFrame:
    """``rows`` (id, source, size) with their source's row of ``known``, rate, and order among extra copies."""
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(cap))
    kept = [c for c in known.columns if c != "source"]
    return (rows.alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")))
            .select("r.*", *kept).withColumn("rate", rate)
            .withColumn("order", _unit_hash(F.col("id"), seed) - (F.col("rate") - F.floor("rate"))))


def _copies(cap: int) -> Column:
    extra = (F.col("rate") < cap) & F.exists("cuts", lambda r: (F.col("order") >= r["low"]) & (F.col("order") < r["high"]))
    return F.when(F.col("size") > 0, F.floor("rate") + extra.cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """What the mix needs to know of each source of ``rows`` (id, source, size): one small row per source."""
    histogram = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stored(source_targets(sources, weights, share, cap), "targets")
    solved = balance(histogram, targets, cap)
    known = stored(targets.alias("t").join(solved.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select(
        "t.source", "t.source_size", "t.target", "unit", "lam", "full"), "multipliers")
    cuts = _rounded(_rated(rows, known, cap, seed), targets, cap)
    return known.alias("k").join(cuts.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source"))).select("k.*", "cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken (copies x size)."""
    rows = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    known = stored(plan(rows, weights, share, cap, seed), "mix-plan")
    return (_rated(rows, known, cap, seed).withColumn("copies", _copies(cap))
            .select("id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies, none for no copies.

    The texts stay where they are: the sources' few numbers come to the documents, whose words are counted again.
    """
    rows = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    known = stored(plan(rows, weights, share, cap, seed), "mix-plan")
    whole = F.struct(*[col(c) for c in docs.columns]).alias("document")
    again = sizes(docs, id_col, text_col, source_col, whole)
    rated = _rated(again, known, cap, seed).withColumn("copies", _copies(cap).cast("int")).filter("copies > 0")
    return rated.select(F.explode(F.array_repeat("document", F.col("copies"))).alias("document")).select("document.*")
