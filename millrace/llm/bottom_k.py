"""Near copies by bottom-k sketches of one hash function.

1. A document's sketch is the ``k`` smallest hashes of its distinct word shingles; equal sets are one from here on.
2. Inverted lists: two sets similar enough share, but for odds of one in billions (``SURE`` standard deviations), a certain
   number of their ``lists`` smallest values, so they meet in the list of one of the rarest of these. A document enters
   only the lists of the values that are rare enough for that; a value that every other page carries is no list.
3. Each list has a hub, its most typical document, and hubs hold for many lists. Every document is compared with the hubs
   of its lists. Then only documents of one hub that are still in different components are compared, in blocks whose
   overlaps come from one matrix product; a block passes on links that join components, not all its pairs.
4. Two documents are compared by the union's sketch: of the ``k`` smallest values of both sketches, the share that both have
   estimates the similarity. Where both sets fit their sketches this is exact; else whole sets are compared as well.

Defined cases: a null or empty text, or one without words, has no set and links with nothing; fewer words than a shingle
are one shingle; rows with one id are one document; a row without an id has no component and is kept; an empty table
gives an empty result; other columns are ignored. Texts may have any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.storage import stored

from . import bit_filter
from .batches import per_text, rows_to_batches, arrow_types
from .components import components
from .shingles import shingle_set

#: Values of a sketch, and how many of them make lists.
K, LISTS = 256, 64
#: Standard deviations by which a similar pair may share less than expected.
SURE = 7.0
#: Ids that are broadcast at most (checked by a count; more are shuffled).
BROADCAST_IDS = 1 << 20
#: Documents of a block: a task compares two blocks.
BLOCK = 256
#: Distinct values of the sketches of two blocks that are counted at a time.
COLUMNS = 1 << 13


def least_common(n: Column, union: Column, k: int, percent: int) -> Column:
    """Values that the k smallest of two similar sets surely share: ``n`` in the smaller set, at most ``union`` in both."""
    p = percent / 100
    spread = F.sqrt(p * (1 - p) * k * F.greatest(F.lit(0.0), 1 - k / union))
    return F.greatest(F.lit(1), F.ceil(p * F.least(n, F.lit(k)) - SURE * spread - 1e-9)).cast("int")


def sketches(docs: DataFrame, size: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (distinct shingles), digest of the whole set, and its k smallest hashes in order."""
    def make():
        def one(text: bytes) -> tuple:
            found = shingle_set(text.lower(), size)  # of bytes: A-Z only
            low = (found[:k] ^ np.uint64(1 << 63)).view(np.int64)  # the same order with a sign
            return len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), low.tolist()
        return one

    return per_text(docs, make, "n long, digest binary, sketch array<long>", id_col, text_col)


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the distinct ``ids``; these are broadcast if a count shows that they are few."""
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _similar(x: str, y: str, k: int, percent: int) -> tuple[Column, Column, Column]:
    """Tests of two rows (n, sketch) by names: whether their sketches allow a link, whether the union's sketch does, and
    whether the first is exact."""
    n, m, s, t = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    both = F.array_intersect(s, t)
    exact = (n <= k) & (m <= k)
    needed = least_common(F.least(n, m), (n + m) * 100 / (100 + percent), k, percent)
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    allowed = sizes & F.when(exact, 100 * F.size(both) >= percent * (n + m - F.size(both))).otherwise(F.size(both) >= needed)
    union = F.slice(F.array_sort(F.array_union(s, t)), 1, k)
    return allowed, exact | (F.size(F.array_intersect(union, both)) >= needed), exact


def _whole_sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id and set of (at least) the documents named; the texts stay where they are."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter.build(ids.select(F.xxhash64("id").alias("key"))))
    source = docs.select(col(id_col).alias("id"), F.xxhash64(col(id_col)).alias("key"), col(text_col).cast("binary").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("hashes", T.BinaryType())])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = bit_filter.may_hold(bits.value, batch.column("key").to_numpy().view(np.uint64))
            few = batch.filter(pa.array(wanted))
            rows = ((i, (shingle_set((t.as_py() or b"").lower(), size).tobytes(),)) for i, t in zip(few.column("id"), few.column("text")))
            yield from rows_to_batches(rows, types)

    return source.mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; only the sets of documents in pairs are made and moved."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    sets = stored(_whole_sets(docs, ids, size, id_col, text_col), "sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b").select("a", "b", "of_a", "of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, T.StructType([both.schema["a"], both.schema["b"]])).distinct()  # a row listed twice has its set twice


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b of the candidates (a, b, exact) that are links."""
    pairs = stored(pairs, "pairs")
    rest = _verified(pairs.filter(~F.col("exact")).select("a", "b"), docs, size, percent, id_col, text_col)
    return stored(pairs.filter("exact").select("a", "b").unionAll(rest), "links")


class _Block:
    """Rows of one side of a task."""

    def __init__(self) -> None:
        self.ids, self.components, self.n, self.sketches = [], [], [], []

    def __len__(self) -> int:
        return len(self.ids)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """Both sides of each run of rows (task, side, id, component, n, sketch) of one task."""
    task, sides = None, (_Block(), _Block())
    for batch in batches:
        t, side, i, component, n = (c.to_pylist() for c in batch.columns[:5])
        values, ends = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        for row in range(len(batch)):
            if t[row] != task:
                if task is not None:
                    yield sides
                task, sides = t[row], (_Block(), _Block())
            block = sides[side[row]]
            block.ids.append(i[row])
            block.components.append(component[row])
            block.n.append(n[row])
            block.sketches.append(values[ends[row]:ends[row + 1]].copy())
    if task is not None:
        yield sides


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values every sketch of ``x`` shares with every one of ``y``."""
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    values, spots, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    shared = times[spots] > 1
    rows, columns = rows[shared], (np.cumsum(times > 1) - 1)[spots[shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, columns[-1] + 1 if len(columns) else 0, COLUMNS):
        low, high = np.searchsorted(columns, [start, start + COLUMNS])
        present = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        present[rows[low:high], columns[low:high] - start] = 1
        out += present[:len(x)] @ present[len(x):].T
    return out


def _candidates(x: _Block, y: _Block, k: int, percent: int, forest: bool) -> Iterator[tuple[int, int, bool]]:
    """Positions of rows of different components whose sketches allow a link, and whether they prove it.

    With ``forest``, only those that join components that earlier ones (the closest first) left apart.
    """
    common = _overlaps(x.sketches, y.sketches)
    n, m = np.array(x.n, float)[:, None], np.array(y.n, float)[None]
    names = {c: at for at, c in enumerate(dict.fromkeys([*x.components, *y.components]))}
    of_x, of_y = (np.array([names[c] for c in b.components]) for b in (x, y))
    exact = (n <= k) & (m <= k)
    p, union = percent / 100, (n + m) * 100 / (100 + percent)
    spread = np.sqrt(p * (1 - p) * k * np.maximum(0.0, 1 - k / union))
    needed = np.maximum(1, np.ceil(p * np.minimum(np.minimum(n, m), k) - SURE * spread - 1e-9))
    likely = np.where(exact, 100 * common >= percent * (n + m - common), common >= needed)
    likely &= (of_x[:, None] != of_y[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j = np.nonzero(likely)
    closest = np.argsort(-common[i, j] - 2 * k * exact[i, j], kind="stable")
    root = list(range(len(names)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for a, b in zip(i[closest].tolist(), j[closest].tolist()):
        p, q = find(of_x[a]), find(of_y[b])
        if forest and p == q:
            continue
        if not exact[a, b]:  # of the smallest values of both, those in both
            low = np.union1d(x.sketches[a], y.sketches[b])[:k]
            if len(np.intersect1d(low, np.intersect1d(x.sketches[a], y.sketches[b], assume_unique=True), assume_unique=True)) < needed[a, b]:
                continue
        root[p] = q
        yield a, b, bool(exact[a, b])


def _within_hubs(star: DataFrame, found: DataFrame, active: DataFrame, k: int, percent: int, forest: bool) -> DataFrame:
    """a, b, exact: candidates among the documents of each hub that are in different components."""
    members = star.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    unlinked = members.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                          F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("low <> high")
    left = members.join(unlinked.select("hub", "blocks"), "hub").join(active.select("id", "n", "sketch"), "id")
    left = left.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = left.select(F.concat_ws(":", "hub", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("own") == F.col("other")).alias("alone"),
                        "id", "component", "n", "sketch")
    both = dealt.drop("alone").unionAll(dealt.filter("alone").withColumn("side", F.lit(1)).drop("alone"))
    schema = T.StructType([T.StructField("a", star.schema["id"].dataType), T.StructField("b", star.schema["id"].dataType), T.StructField("exact", T.BooleanType())])
    types = pa.schema(arrow_types(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _tasks(batches):
            if len(x) and len(y):
                pairs = [(x.ids[a], y.ids[b], sure) for a, b, sure in _candidates(x, y, k, percent, forest)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pairs), types)], schema=types)

    found = both.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "exact").distinct()


def similar_components(docs: DataFrame, size: int = 3, percent: int = 85, k: int = K, lists: int = LISTS, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component. Links: 100 * common shingles >= percent * shingles of either."""
    every = stored(sketches(docs, size, k, id_col, text_col), "sketches")
    classes = stored(every.filter("n > 0 and id is not null").groupBy("n", "digest").agg(F.min("id").alias("first")), "classes")
    leaders = _among(every.select("id", "n", "sketch"), classes.select(F.col("first").alias("id")))

    # the lists: of each document's values that others have too, the rarest, as many as a similar document may lack, and one
    values = leaders.select("id", "n", F.explode(F.slice("sketch", 1, lists)).alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    shared = (values.join(counts, "value").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("times", "value"))).alias("found")))
    spare = F.size("found") - least_common(F.col("n"), F.col("n") * 100 / percent, lists, percent) + 1
    entries = stored(shared.filter(spare > 0).select(
        "id", F.col("found")[F.floor(F.size("found") / 2).cast("int")].times.alias("typical"), F.slice("found", F.lit(1), spare).value.alias("rare")), "entries")
    active = stored(_among(leaders, entries.select("id")).join(entries, "id"), "active")

    placed = entries.select("id", "typical", F.explode("rare").alias("value"))
    hubs = placed.groupBy("value").agg(F.max(F.struct("typical", "id")).alias("hub"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    star = stored(placed.join(hubs.select("value", F.col("hub.id").alias("hub")), "value").filter("id <> hub").select("hub", "id").distinct(), "star")
    allowed, estimated, exact = _similar("x", "y", k, percent)
    with_hub = star.join(active, "id").alias("x").join(_among(active, star.select(F.col("hub").alias("id")).distinct()).alias("y"), F.col("x.hub") == F.col("y.id"))
    near = with_hub.filter(allowed).filter(estimated).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), exact.alias("exact")).distinct()
    links = _links(near, docs, size, percent, id_col, text_col)
    found = components(links)

    # documents that their hub didn't link: first the closest of different components, then all that are left
    for forest in (True, False):
        more = _links(_within_hubs(star, found, active, k, percent, forest), docs, size, percent, id_col, text_col)
        if more.isEmpty():
            continue
        links = stored(links.unionAll(more), "links")
        found = components(links)
    final = found

    by_first = classes.join(final.withColumnRenamed("id", "first"), "first", "left").select("n", "digest", F.coalesce("component", "first").alias("component"))
    own = F.when(F.col("r.n") > 0, F.col("component")).otherwise(F.col("r.id"))
    return (every.select("id", "n", "digest").alias("r").join(by_first.alias("c"), (F.col("r.n") == F.col("c.n")) & (F.col("r.digest") == F.col("c.digest")), "left")
            .select("r.id", F.col("r.n").alias("n_shingles"), F.when(F.col("r.id").isNotNull(), own).alias("component")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component, and whether the document stays: it names its component, or has no id."""
    found = similar_components(docs, size, percent, id_col=id_col, text_col=text_col)
    return found.withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("component")))
