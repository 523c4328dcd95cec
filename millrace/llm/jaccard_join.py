"""Grouped prefix join: documents whose word-shingle sets are similar, and the components that the links form.

1. Documents with equal sets are one from here on (the one with the smallest id).
2. Shingles are ordered by how often they occur, rarest first, with a table of counters of fixed size. Two similar
   sets share a shingle in their prefixes, the rarest few of each.
3. Documents with the same prefix and size form a group. Groups meet in the buckets of their prefix shingles; a bucket has
   a hub, its most common prefix, and hubs hold for many buckets. Every group is paired with the hubs of its buckets, and
   every member of a group with the group's first one. The sizes and the shingles that both prefixes have bound the
   common shingles; the pairs left are expanded to members and verified on whole sets.
4. Then only groups of one hub that are still in different components are paired, in blocks whose common prefix
   shingles come from one matrix product: first the closest that would join components, then all that the bound
   leaves. So a large group of near copies never gives all its pairs, and yet no component is missed.

Verification compares whole sets of 64-bit shingle hashes. Defined cases: a null or empty text, or one without words,
has no set and links with nothing; fewer words than a shingle are one shingle; rows with one id are one document; a
row without an id has no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.storage import stored

from . import bit_filter
from .batches import arrow_types, release, rows_to_batches, small_batches
from .bottom_k import _overlaps
from .components import components
from .drops import without
from .shingles import shingle_set

#: Counters of the shingle frequencies (as bits), and how many go in one row. Their size does not grow with the data:
#: 16 MB, one byte each. Beyond a few billion shingles only frequencies above the counters' mean still show.
COUNTER_BITS, CHUNK_BITS = 24, 18
MOST = 255
#: Groups of a block and prefix shingles in it, both on average: a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def _lower(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def _sets(docs: DataFrame, size: int, make: Callable, fields: str, id_col: str, text_col: str) -> DataFrame:
    """Rows that ``make()(id, key, shingle set)`` gives for each document; a last call without arguments ends the task."""
    source = docs.select(col(id_col).alias("id"), F.xxhash64(col(id_col)).alias("key"), col(text_col).cast("binary").alias("text"))
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string(fields).fields])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        one, end = make()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, key, text in zip(*batch.columns):
                    got = one(key.as_py(), lambda text=text: shingle_set(_lower(text.as_py() or b""), size))
                    if got is not None:
                        yield i, got
            yield from end()

        yield from rows_to_batches(rows(), types)

    return source.mapInArrow(run, schema)


def _summaries(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (id, n, digest) and, with ``chunk``, the tasks' counters."""
    def make() -> tuple[Callable, Callable]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint8)

        def one(_: int, hashes: Callable) -> tuple:
            found = hashes()
            spots, times = np.unique(found & np.uint64((1 << COUNTER_BITS) - 1), return_counts=True)
            spots = spots.astype(np.int64)
            counts[spots] = np.minimum(counts[spots].astype(np.int64) + times, MOST)
            return len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), None, None

        def end() -> Iterator[tuple]:
            for k, part in enumerate(np.split(counts, 1 << (COUNTER_BITS - CHUNK_BITS))):
                if part.any():
                    yield None, (None, None, k, zlib.compress(part.tobytes(), 1))

        return one, end

    return _sets(docs, size, make, "n long, digest binary, chunk int, counts binary", id_col, text_col)


def _counters(rows: DataFrame) -> np.ndarray:
    """The tasks' counters added up, each at most MOST: 2 ** COUNTER_BITS bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*batch.columns):
                part = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).astype(np.uint16)
                total[k] = np.minimum(total[k] + part, MOST) if (k := chunk.as_py()) in total else part
        yield from rows_to_batches(((k, (v.astype(np.uint8).tobytes(),)) for k, v in total.items()), [("chunk", pa.int32()), ("counts", pa.binary())])

    parts = 1 << (COUNTER_BITS - CHUNK_BITS)
    added = rows.select("chunk", "counts").repartition(parts, "chunk").mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((parts, 1 << CHUNK_BITS), np.uint8)
    for row in added.toLocalIterator():
        out[row.chunk] = np.frombuffer(row.counts, np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, counters: Any, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, group (hash of size and prefix), central (how common the prefix is) and the prefix in order."""
    def make() -> tuple[Callable, Callable]:
        counts = counters.value

        def one(_: int, hashes: Callable) -> tuple | None:
            found = hashes()
            n = len(found)
            if not n:
                return None
            often = counts[(found & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)].astype(np.uint64)
            order = np.argsort((often << np.uint64(56)) | (found >> np.uint64(8)), kind="stable")[:n - -(-percent * n // 100) + 1]
            prefix = found[order]
            group = hashlib.blake2b(n.to_bytes(8, "little") + prefix.tobytes(), digest_size=8).digest()
            return n, int.from_bytes(group, "little", signed=True), int(np.median(often[order])), prefix.view(np.int64)

        return one, lambda: iter(())

    return _sets(docs, size, make, "n long, grp long, central long, prefix array<long>", id_col, text_col)


def _may_be_similar(n: Any, m: Any, common: Any, greatest: Callable, percent: int) -> Any:
    """Whether sets of sizes n and m with ``common`` shingles in both prefixes may be similar (columns or arrays).

    Of the two prefixes, take the one that ends first in the order: the other holds all of its shingles that both sets
    have, so only shingles behind it add to ``common``.
    """
    behind = greatest(_behind(n, percent), _behind(m, percent))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (common > 0) & ((common + behind) * (100 + percent) >= percent * (n + m))


def _behind(n: Any, percent: int) -> Any:
    """Shingles of a set behind its prefix."""
    needed = percent * n + 99
    return (F.floor(needed / 100) if isinstance(n, Column) else needed // 100) - 1


def _whole_sets(docs: DataFrame, bits: Any, size: int, id_col: str, text_col: str) -> DataFrame:
    """id and set of (at least) the documents in the broadcast filter; the texts stay where they are."""
    def make() -> tuple[Callable, Callable]:
        words = bits.value

        def one(key: int, hashes: Callable) -> tuple | None:
            if not bit_filter.may_hold(words, np.array([key], np.int64).view(np.uint64))[0]:
                return None
            return (hashes().tobytes(),)

        return one, lambda: iter(())

    return _sets(docs, size, make, "hashes binary", id_col, text_col)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of ids whose whole sets are similar, and all pairs; only sets of documents in pairs are made and moved."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs, pairs
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter.build(ids.select(F.xxhash64("id").alias("key"))))
    sets = stored(_whole_sets(docs, bits, size, id_col, text_col), "sets")
    bits.unpersist()
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b").select("a", "b", "of_a", "of_b"))
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, schema).distinct(), "links"), pairs  # a row listed twice has its set twice


class _Block:
    """Rows of one side of a task: groups, each with one of its components."""

    def __init__(self) -> None:
        self.groups, self.components, self.n, self.shared = [], [], [], []


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """Both sides of each run of rows (task, side, grp, component, n, shared) of one task."""
    task, sides = None, (_Block(), _Block())
    for batch in batches:
        names, side, groups, parts, n = (c.to_pylist() for c in batch.columns[:5])
        values, ends = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        for row, name in enumerate(names):
            if name != task:
                if task is not None:
                    yield sides
                task, sides = name, (_Block(), _Block())
            block = sides[side[row]]
            block.groups.append(groups[row])
            block.components.append(parts[row])
            block.n.append(n[row])
            block.shared.append(values[ends[row]:ends[row + 1]].copy())
    if task is not None:
        yield sides


def _candidates(x: _Block, y: _Block, percent: int, forest: bool) -> Iterator[tuple[int, int]]:
    """Positions of rows of different components whose prefixes allow a link; with ``forest``, only those that would join
    components that earlier ones (the closest first) leave apart."""
    if not (x.groups and y.groups):
        return
    common = _overlaps(x.shared, y.shared).astype(np.int64)
    n, m = np.array(x.n, np.int64)[:, None], np.array(y.n, np.int64)[None]
    names = {c: at for at, c in enumerate(dict.fromkeys([*x.components, *y.components]))}
    of_x, of_y = (np.array([names[c] for c in b.components]) for b in (x, y))
    equal = np.array(x.groups)[:, None] == np.array(y.groups)[None]  # the same prefix
    likely = (of_x[:, None] != of_y[None]) & (equal | _may_be_similar(n, m, common, np.maximum, percent))
    i, j = np.nonzero(likely)
    closest = np.argsort(-(common + _behind(np.minimum(n, m), percent))[i, j] / np.maximum(n, m)[i, j], kind="stable")
    root = list(range(len(names)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for a, b in zip(i[closest].tolist(), j[closest].tolist()):
        if forest:
            p, q = find(of_x[a]), find(of_y[b])
            if p == q:
                continue
            root[p] = q
        yield a, b


def _within_hubs(star: DataFrame, placed: DataFrame, active: DataFrame, percent: int, forest: bool) -> DataFrame:
    """a, b: documents of groups of one hub that are in different components and may be similar."""
    units = stored(placed.groupBy("grp", "component").agg(F.min("id").alias("first")), "units")
    mixed = units.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rows = (star.unionAll(mixed.select(F.col("grp").alias("hub"), "grp")).distinct().join(units.select("grp", "component"), "grp")
            .join(active.select("grp", "n", "shared"), "grp", "left")
            .withColumns({"n": F.coalesce("n", F.lit(0)), "shared": F.coalesce("shared", F.array().cast("array<bigint>"))}))
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("shared")) / BLOCK_SHINGLES)
    unlinked = (rows.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(weight).cast("int").alias("blocks"))
                .filter("low <> high").select("hub", "blocks"))
    left = (rows.join(unlinked, "hub").withColumn("own", F.pmod(F.xxhash64("grp", "component"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    alone = F.col("own") == F.col("other")
    sides = F.when(alone, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("own") > F.col("other"), 1).otherwise(0)))
    dealt = left.select(F.concat_ws(":", "hub", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.explode(sides).alias("side"),
                        "grp", "component", "n", "shared")
    kind = units.schema["component"].dataType
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("in_x", kind), T.StructField("y", T.LongType()), T.StructField("in_y", kind)])
    types = pa.schema(arrow_types(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for x, y in _tasks(batches):
            found = [(x.groups[a], x.components[a], y.groups[b], y.components[b]) for a, b in _candidates(x, y, percent, forest)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), types)], schema=types)

    found = dealt.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, schema).distinct()
    of = units.select("grp", "component", F.col("first").alias("id")) if forest else placed
    of_x = of.select(F.col("grp").alias("x"), F.col("component").alias("in_x"), F.col("id").alias("a"))
    of_y = of.select(F.col("grp").alias("y"), F.col("component").alias("in_y"), F.col("id").alias("b"))
    return found.join(of_x, ["x", "in_x"]).join(of_y, ["y", "in_y"]).select("a", "b")


def similar_components(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component. Links: 100 * common shingles >= percent * shingles of either."""
    with small_batches(docs.sparkSession):
        return _similar_components(docs, size, percent, id_col, text_col)


def _similar_components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    summaries = stored(_summaries(docs, size, id_col, text_col), "summaries")
    rows = summaries.filter("chunk is null").select("id", "n", "digest")
    counters = spark.sparkContext.broadcast(_counters(summaries.filter("chunk is not null")))
    classes = stored(rows.filter("n > 0").groupBy("n", "digest").agg(F.min("id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("id"))

    prefixes = stored(_prefixes(docs, counters, size, percent, id_col, text_col), "prefixes")
    counters.unpersist()
    members = stored(prefixes.select("id", "grp").join(firsts, "id", "left_semi").distinct(), "members")
    groups = stored(members.groupBy("grp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")), "groups")
    # one document speaks for its group; an id listed twice adds equal rows only
    leaders = prefixes.join(groups.select("grp", F.col("first").alias("id")), ["id", "grp"], "left_semi")
    entries = leaders.select("grp", "n", "central", F.explode("prefix").alias("shingle"))
    hubs = (entries.groupBy("shingle").agg(F.min("grp").alias("least"), F.max("grp").alias("most"), F.max(F.struct("central", "grp")).grp.alias("hub"))
            .filter("least <> most").select("shingle", "hub"))
    met = stored(entries.select("grp", "n", "shingle").join(hubs, "shingle"), "met")
    active = stored(met.groupBy("grp", "n").agg(F.collect_set("shingle").alias("shared")), "active")  # at most a prefix each
    star = stored(met.select("hub", "grp").distinct(), "star")

    common = F.size(F.array_intersect("x.shared", "y.shared"))
    near = (star.filter("hub <> grp").join(active, "grp").alias("x").join(active.alias("y"), F.col("x.hub") == F.col("y.grp"))
            .filter(_may_be_similar(F.col("x.n"), F.col("y.n"), common, F.greatest, percent)).select("x.grp", "x.hub"))
    firsts_of = groups.select(F.col("grp").alias("hub"), F.col("first").alias("b"))
    many = groups.filter("members > 1").select("grp", F.col("first").alias("b"))
    pairs = (members.join(near.join(firsts_of, "hub").select("grp", "b").unionAll(many), "grp").filter("id <> b")
             .select(F.col("id").alias("a"), "b").distinct())
    links, tested = _verified(pairs, docs, size, percent, id_col, text_col)
    final = components(links)
    shared = many.select("grp").unionAll(active.select("grp")).distinct()
    members = stored(members.join(shared, "grp", "left_semi"), "shared-members")

    # groups that their hub didn't link: first the closest of different components, then all that are left
    for forest in (True, False):
        placed = stored(members.join(final, "id", "left").select("id", "grp", F.coalesce("component", "id").alias("component")), "placed")
        pairs = _within_hubs(star, placed, active, percent, forest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more, these = _verified(pairs.join(done, ["a", "b"], "left_anti"), docs, size, percent, id_col, text_col)
        tested = tested.unionAll(these)
        if not more.isEmpty():
            links = links.unionAll(more)
            final = components(links)

    by_first = classes.join(final.withColumnRenamed("id", "first"), "first", "left").select("n", "digest", F.coalesce("component", "first").alias("component"))
    own = F.when(F.col("r.n") > 0, F.col("component")).otherwise(F.col("r.id"))
    return (rows.alias("r").join(by_first.alias("c"), (F.col("r.n") == F.col("c.n")) & (F.col("r.digest") == F.col("c.digest")), "left")
            .select("r.id", F.col("r.n").alias("n_shingles"), F.when(F.col("r.id").isNotNull(), own).alias("component")))


def drop_similar(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Rows without an id stay."""
    found = stored(similar_components(docs, size, percent, id_col, text_col), "similar")
    return without(docs, found.filter("id <> component").select("id"), id_col)
