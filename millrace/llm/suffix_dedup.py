"""Removing repeated passages with suffix arrays of shards.

A byte goes if a string of ``WINDOW`` bytes around it also starts earlier, in a document with a smaller id or earlier
in the same one. Every such string has one anchor, its ``ANCHOR`` bytes with the smallest hash, so equal strings have
equal anchors, and the strings of one anchor lie next to each other in a text: a stretch.

1. Anchors that occur once are left out; what remains are stretches of possibly repeated strings.
2. Equal stretches are one from here on; all but the first go.
3. The different stretches of an anchor meet in a shard, which makes a suffix array of its stretches by induced
   sorting and permuted common prefixes; runs of common prefixes of ``WINDOW`` bytes are equal strings, of which all
   but the earliest go. Stretches of an anchor with more different ones than fill a shard are taken apart
   instead: halves with unique bytes beside the anchor are left out, the strings of the others are grouped by hash
   with map-side combination, so no shard grows with a common line.
4. The strings' places are united for each document.

Only hashes and the stretches in question are moved, and texts of documents that lose something. Defined cases: a null
or empty text has no bytes; texts shorter than the window lose nothing; equal texts after the first lose all from the
window's length on; rows without an id lose nothing and are not compared; rows with one id must have one text; an
empty table gives an empty result; other columns are ignored. Cuts may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.storage import stored

from . import bit_filter
from .batches import arrow_types, rows_to_batches
from .shingles import mixed, sums
from .suffix_array import common_prefixes, suffix_array

WINDOW, ANCHOR = 100, 32
#: Stretch bytes of a shard, about.
SHARD_BYTES = 1 << 20
#: Different stretches of an anchor that may meet in a shard: about as many as fill it.
CROWD = SHARD_BYTES // WINDOW
#: Bytes of a text looked at together; the next part begins a window's length before its end.
PART = 1 << 22
#: Short texts are joined until they have so many bytes: enough to outweigh the calls, few enough for a core's cache.
JOINED = 1 << 17


def stretches(text: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, content hash, start and number of strings of the stretches of a text, some at a time."""
    for _, *found in all_stretches([text], window, anchor):
        yield tuple(found)


def all_stretches(texts: Iterable[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for many texts, and before it the number of the text. Short texts are looked at together."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for base in range(0, len(text) - window + 1, PART - window + 1):
            part = text[base:base + PART]
            held.append((k, base, part))
            size += len(part)
            if size >= JOINED:
                yield _part_stretches(held, window, anchor)
                held, size = [], 0
    if held:
        yield _part_stretches(held, window, anchor)


def _part_stretches(parts: list[tuple[int, int, bytes]], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The stretches of parts (number of the text, place in it, bytes) that are as long as the window at least."""
    text = b"".join(part for _, _, part in parts)
    number, base, size = (np.array(x, np.int64) for x in zip(*((k, b, len(part)) for k, b, part in parts)))
    close = np.cumsum(size)
    first = close - size
    n = len(text) - window + 1
    total, down = sums(text)
    m = len(text) - anchor + 1
    with np.errstate(over="ignore"):
        h = mixed((total[anchor:] - total[:-anchor]) * down[:m])
    least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)  # equal ones: leftmost
    width, span = window - anchor + 1, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(at[1:], at[:-1], out=edge[1:n])
    edge[first[1:]] = edge[first[1:] - window + 1] = True  # what lies between the two crosses into the next part
    edge = np.flatnonzero(edge)
    start, end = edge[:-1], edge[1:]
    owner = np.searchsorted(first, start, side="right") - 1
    inside = start + window <= close[owner]
    start, end, owner = start[inside], end[inside], owner[inside]
    stop = end + window - 1
    with np.errstate(over="ignore"):
        content = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return number[owner], h[at[start]], content, start - first[owner] + base[owner], end - start


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))


def _anchors(source: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for _, anchor, *_ in all_stretches((text.as_py() or b"" for text in batch.column(0)), window):
                    yield (anchor,)

        for (anchor,) in _gathered(each()):
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return source.select("text").mapInArrow(run, "anchor long")


def _gathered(arrays: Iterator[tuple], rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays joined until they are long enough for a batch."""
    held, n = [], 0
    for each in arrays:
        held.append(each)
        n += len(each[0])
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _suspects(source: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """id, anchor, content, start, n of the stretches whose anchor may occur twice."""
    bits = source.sparkSession.sparkContext.broadcast(bit_filter.build(repeated))
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("anchor long, content long, start long, n long").fields])
    types = pa.schema(arrow_types(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            ids, texts = batch.columns

            def each(texts: pa.Array = texts) -> Iterator[tuple]:
                for k, anchor, content, *more in all_stretches((text.as_py() or b"" for text in texts), window):
                    keep = np.flatnonzero(bit_filter.may_hold(words, anchor))
                    if len(keep):
                        yield k[keep], *(x[keep].view(np.int64) for x in (anchor, content)), *(x[keep] for x in more)

            for k, *values in _gathered(each()):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), *map(pa.array, values)], schema=types)

    return source.mapInArrow(run, schema)


def _texts_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of (at least) the documents named; a filter drops most others before they move."""
    bits = source.sparkSession.sparkContext.broadcast(bit_filter.build(ids.select(F.xxhash64("id").alias("key"))))
    keyed = source.select("id", "text", F.xxhash64("id").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bit_filter.may_hold(bits.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return keyed.mapInArrow(run, source.schema)


def _slices(source: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """id, anchor, start and bytes of the stretches ``wanted`` (id, anchor, start, n)."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("wanted"))
    joined = _texts_of(source, lists).join(lists, "id")
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("anchor long, start long, content binary").fields])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, text, listed in zip(*batch.columns):
                    text = text.as_py()
                    for w in listed.as_py():
                        yield i, (w["anchor"], w["start"], text[w["start"]:w["start"] + w["n"] + window - 1])

        yield from rows_to_batches(rows(), types, 8192)

    return joined.mapInArrow(run, schema)


def repeats(ids: list, starts: list[int], contents: list[bytes], window: int = WINDOW) -> Iterator[tuple]:
    """(id, start, n): runs of strings in the stretches that also start earlier in another or the same one."""
    if not contents:
        return
    rank = {x: k for k, x in enumerate(sorted(set(ids)))}
    sizes = np.array([len(c) for c in contents], np.int64)
    first = np.r_[0, np.cumsum(sizes[:-1] + 1)]
    raw = b"\xff".join(contents)
    text = np.r_[np.frombuffer(raw, np.uint8).astype(np.int64) + 2, 0]
    text[first[1:] - 1] = 1
    order = suffix_array(text, 258)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(text)) - first[owner]
    valid = offset + window <= sizes[owner]
    row = order[valid[order]]
    # strings of one group are neighbours among the valid ones, see the common prefix of each with the one before it
    group = np.cumsum(common_prefixes(text, row, window)[row] < window)
    place = np.array(starts, np.int64)[owner[row]] + offset[row]
    doc = np.array([rank[i] for i in ids], np.int64)[owner[row]]
    by = np.lexsort((place, doc, group))
    # all after the first place of a group; a place listed twice is one place
    head = np.r_[True, group[by][1:] != group[by][:-1]]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    later = (doc[by] != doc[by][lead]) | (place[by] != place[by][lead])
    hit = np.sort(row[by][later])
    if len(hit):
        cuts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(hit)]):
            k = owner[hit[a]]
            yield ids[k], (int(starts[k] + offset[hit[a]]), int(b - a))


def _shard_repeats(slices: DataFrame, shards: int, window: int) -> DataFrame:
    schema = T.StructType([slices.schema["id"], *T._parse_datatype_string("start long, n long").fields])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, contents = [], [], []
        for batch in batches:  # a shard is a partition
            ids += batch.column(0).to_pylist()
            starts += batch.column(1).to_pylist()
            contents += batch.column(2).to_pylist()
        yield from rows_to_batches(repeats(ids, starts, contents, window), types, 8192)

    return slices.repartition(shards, "anchor").select("id", "start", "content").mapInArrow(run, schema)


def _halves(content: bytes, window: int, anchor: int) -> Iterator[tuple[int, int, int, int]]:
    """A stretch in two: the strings that reach far to the left of the anchor, and the others, which reach far to the right.

    Side, hash of the bytes that all strings of the half have beside the anchor, first string, number of strings.
    """
    far = (window - anchor) // 2
    total, down = sums(content)
    n = len(content) - window + 1
    with np.errstate(over="ignore"):
        h = mixed((total[anchor:window + 1] - total[:window - anchor + 1]) * down[:window - anchor + 1])
        at = int(np.argmin(h >> np.uint64(24)))

        def beside(a: int, b: int) -> int:
            return int(mixed((total[b:b + 1] - total[a:a + 1]) * down[a:a + 1]).view(np.int64)[0])

        left = min(n, max(0, at - far + 1))
        if left:
            yield 0, beside(at - far, at), 0, left
        if left < n:
            yield 1, beside(at + anchor, at + anchor + far), left, n - left


def _crowd_repeats(slices: DataFrame, window: int, anchor: int = ANCHOR) -> DataFrame:
    """The same for anchors with very many stretches.

    Halves whose bytes beside the anchor occur once are left out: a common short line among different contexts ends
    there. The strings of the others are grouped by hash, the earliest found with map-side combination.
    """
    id_field = slices.schema["id"]
    halves_schema = T.StructType([id_field, *T._parse_datatype_string("anchor long, side int, beside long, start long, content binary").fields])
    halves_types = arrow_types(halves_schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, a, start, content in zip(*batch.columns):
                    content, a, start = content.as_py(), a.as_py(), start.as_py()
                    for side, beside, first, n in _halves(content, window, anchor):
                        yield i, (a, side, beside, start + first, content[first:first + n + window - 1])

        yield from rows_to_batches(rows(), halves_types, 8192)

    same = ["anchor", "side", "beside"]
    halves = stored(slices.mapInArrow(split, halves_schema), "halves")
    again = halves.groupBy(*same).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*same)
    halves = halves.join(again, same, "left_semi").select("id", "anchor", "start", "content")
    schema = T.StructType([id_field, *T._parse_datatype_string("anchor long, string long, start long").fields])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, a, start, content in zip(*batch.columns):
                    content, a, start = content.as_py(), a.as_py(), start.as_py()
                    total, down = sums(content)
                    n = len(content) - window + 1
                    with np.errstate(over="ignore"):
                        strings = mixed((total[window:] - total[:-window]) * down[:n]).view(np.int64).tolist()
                    for k, s in enumerate(strings):
                        yield i, (a, s, start + k)

        yield from rows_to_batches(rows(), types, 16384)

    strings = stored(halves.mapInArrow(run, schema), "crowd-strings")
    same = ["anchor", "string"]
    first = strings.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "start")).alias("first")).filter("times > 1")
    return (strings.join(first, same).filter((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
            .select("id", "start", F.lit(1).cast("bigint").alias("n")))


def repeated_strings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                     shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """id, start, n: in document ``id`` the n strings from byte ``start`` on also start earlier. Rows may overlap."""
    source = _source(docs, id_col, text_col)
    repeated = stored(_anchors(source, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    found = stored(_suspects(source, repeated, window), "stretches")
    contents = stored(found.groupBy("anchor", "content").agg(
        F.min(F.struct("id", "start", "n")).alias("first"), F.count(F.lit(1)).alias("times")), "contents")
    again = (found.join(contents.filter("times > 1"), ["anchor", "content"])
             .filter((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start"))).select("id", "start", "n"))
    crowds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    firsts = contents.join(crowds, "anchor").select("anchor", "different", "first.id", "first.start", "first.n")
    firsts = stored(firsts, "different-stretches")
    total = firsts.filter(F.col("different") <= crowd).agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    slices = stored(_slices(source, firsts.select("id", "anchor", "start", "n"), window), "slices")
    crowded = crowds.filter(F.col("different") > crowd).select("anchor")
    out = again.unionAll(_shard_repeats(slices.join(crowded, "anchor", "left_anti"), max(1, -(-total // shard_bytes)), window))
    return out.unionAll(_crowd_repeats(slices.join(crowded, "anchor", "left_semi").select("id", "anchor", "start", "content"), window))


def united(starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the strings cover."""
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.maximum.accumulate(starts + counts[order] + window - 1)
    gap = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return starts[np.concatenate([[0], gap])], ends[np.concatenate([gap - 1, [len(ends) - 1]])]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (start and end of the runs removed), kept_sha256."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = stored(docs.select(col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole")), "whole-texts")
    strings = repeated_strings(docs, window, id_col, text_col, shard_bytes, crowd)
    lists = strings.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("strings"))
    span = "array<struct<start long, end long>>"
    merged_schema = T.StructType([lists.schema["id"], *T._parse_datatype_string(f"spans {span}").fields])
    merged_types = arrow_types(merged_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed = batch.columns
            at, flat = listed.offsets.to_numpy(), listed.values
            starts, counts = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = [united(starts[a:b], counts[a:b], window) for a, b in zip(at[:-1], at[1:])]
            offsets = np.cumsum([0, *(len(x) for x, _ in found)])
            both = [pa.array(np.concatenate(x)) for x in zip(*found)] or [pa.array([], pa.int64())] * 2
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, ["start", "end"]))
            yield pa.RecordBatch.from_arrays([ids, spans.cast(merged_types[1][1])], schema=pa.schema(merged_types))

    spans = stored(lists.mapInArrow(merge, merged_schema), "spans")
    sized = stored(spans.join(rows.dropDuplicates(["id"]), "id").select("id", "spans", "n_bytes"), "sized-spans")
    whole = (F.size("spans") == 1) & (F.col("spans")[0]["end"] - F.col("spans")[0]["start"] == F.col("n_bytes"))
    part = sized.filter(~whole).select("id", "spans")
    joined = _texts_of(_source(docs, id_col, text_col), part).dropDuplicates(["id"]).join(part, "id").select("id", "text", "spans")
    schema = T.StructType([joined.schema["id"], *T._parse_datatype_string("kept string").fields])
    types = arrow_types(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for i, text, listed in zip(*batch.columns):
                    text, at, kept = text.as_py(), 0, hashlib.sha256()
                    for s in listed.as_py():
                        kept.update(text[at:s["start"]])
                        at = s["end"]
                    kept.update(text[at:])
                    yield i, (kept.hexdigest(),)

        yield from rows_to_batches(each(), types)

    kept = joined.mapInArrow(cut, schema).unionAll(sized.filter(whole).select("id", F.sha2(F.lit(""), 256).alias("kept")))
    changed = sized.join(kept, "id").select("id", "spans", "kept")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return (rows.join(changed, "id", "left")
            .select("id", "n_bytes", F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
                    F.greatest(F.size(F.coalesce("spans", F.array().cast(span))), F.lit(0)).cast("bigint").alias("n_spans"),
                    F.coalesce("spans", F.array().cast(span)).alias("spans"), F.coalesce("kept", "whole").alias("kept_sha256")))
