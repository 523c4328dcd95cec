"""Cutting long CSV and JSON files into records in many tasks, where a record's end can't be told from a line alone.

A file is read in pieces (lines, or the text up to each closing brace) by as many tasks as it has blocks. A small automaton
tells where records end: its state is whether a quoted text is open, and how deep the brackets are nested. A task doesn't
know the state in which its block begins, so it follows all of them and returns one line of a transition table for each;
the tables of a file's blocks compose, in order, to the state at the start of every block. With these a second pass cuts
the records. A record that runs over borders of blocks comes in parts, which are joined by the block it began in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of all files whose states are sent to the tasks, some 100 bytes each. Beyond it a larger
#: ``spark.sql.files.maxPartitionBytes`` makes fewer.
BLOCKS = 1 << 20
#: Blocks whose records make a partition, if there are more blocks than shuffle partitions.
BLOCKS_A_PARTITION = 8
#: Place of a record that runs on behind its block: it is the last that began there.
LAST = 1 << 62
#: Bytes of records gathered before a batch is passed on.
FLUSH = 4 << 20


@dataclass(frozen=True)
class Grammar:
    """How records end: ``scan(piece, state)`` gives the state behind a piece and the change in depth."""

    separator: str
    states: int
    scan: Callable[[str, int], tuple[int, int]]
    #: What a piece must contain to change anything; empty: each does.
    marks: str
    #: What comes back between two pieces of a record: ``piece + kept`` is what was read.
    kept: str
    #: Whether records may lie one level deep, in an array.
    nested: bool


def csv_grammar(sep: str = ",", quote: str = '"') -> Grammar:
    """State 1: a quoted field is open. A quote opens one at the start of a field only; two quotes stand for one."""
    def scan(line: str, state: int) -> tuple[int, int]:
        at = 0
        while True:
            if not state:  # at the start of a field
                if not line.startswith(quote, at):
                    at = line.find(sep, at) + len(sep)
                    if at < len(sep):
                        return 0, 0
                    continue
                at += len(quote)
            state = 0
            at = line.find(quote, at)
            if at < 0:
                return 1, 0
            at += len(quote)
            if line.startswith(quote, at):
                at, state = at + len(quote), 1
                continue
            at = line.find(sep, at) + len(sep)
            if at < len(sep):
                return 0, 0

    return Grammar("\n", 2, scan, re.escape(quote), "\n", False)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def _scan_json(piece: str, state: int) -> tuple[int, int]:
    """State 1: a string is open. As a piece ends with a brace, no escape is ever cut in two."""
    piece += "}"
    if state:
        end = _REST_OF_STRING.match(piece)
        if end is None:
            return 1, 0
        piece = piece[end.end():]
    plain, quote, _ = _STRING.sub("", piece).partition('"')
    return len(quote), plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")


def json_grammar() -> Grammar:
    return Grammar("}", 2, _scan_json, "", "}", True)


def _pieces(spark: SparkSession, path: str | Sequence[str], grammar: Grammar) -> DataFrame:
    """value, file, start (of the block) of all pieces, in order within a block."""
    text = spark.read.option("lineSep", grammar.separator).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch], marks: str) -> Iterator[tuple[str, int, str, bool]]:
    """file, start, piece, and whether the piece may hold marks."""
    for batch in batches:
        marked = pc.match_substring_regex(batch.column(0), marks).to_pylist() if marks else [True] * len(batch)
        yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist(), marked)


def _tables(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """file, start, array (the text opens with a bracket), and for each state: the state behind the block, the change in
    depth, and the least depth at the end of a piece outside quotes. ``alone``: every piece that begins a record ends it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tracks, array, alone = None, [], None, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "file": key[0], "start": key[1], "array": bool(array), "alone": alone, "behind": [t[0] for t in tracks],
                "depth": [t[1] for t in tracks], "least": [t[2] for t in tracks]}], schema=types)

        for file, start, piece, marked in _runs(batches, grammar.marks):
            if (file, start) != key:
                if key is not None:
                    yield row()
                key, tracks, array, alone = (file, start), [[s, 0, None] for s in range(grammar.states)], None, True
            if array is None and (bare := piece.lstrip("\ufeff \t\r\n")):
                array = bare[0] == "["
            for track in tracks:
                if marked:
                    track[0], change = grammar.scan(piece, track[0])
                    track[1] += change
                if track[0] == 0:
                    track[2] = track[1] if track[2] is None else min(track[2], track[1])
            alone = alone and tracks[0][0] == 0
        if key is not None:
            yield row()

    types = pa.schema([("file", pa.string()), ("start", pa.int64()), ("array", pa.bool_()), ("alone", pa.bool_()), ("behind", pa.list_(pa.int32())),
                       ("depth", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))])
    return pieces.mapInArrow(run, "file string, start long, array boolean, alone boolean, behind array<int>, depth array<long>, least array<long>")


def _entries(tables: DataFrame, grammar: Grammar) -> DataFrame:
    """file, start, and where the block begins: state, depth, the depth of records, and the block the open record began in."""
    names = ["file", "start", "state", "level", "base", "began"]

    def run(blocks):
        import pandas as pd

        out, state, level, began, base = [], 0, 0, None, 0
        for b in blocks.sort_values("start").itertuples():
            if began is None:
                began, base = b.start, int(grammar.nested and b.array)
            out.append((b.file, b.start, state, level, base, began))
            least = b.least[state]
            if least is not None and least == least and level + least <= base:
                began = b.start
            state, level = b.behind[state], level + b.depth[state]
        return pd.DataFrame(out, columns=names)

    return tables.groupBy("file").applyInPandas(run, "file string, start long, state int, level long, base int, began long")


def cut(spark: SparkSession, path: str | Sequence[str], grammar: Grammar, found: DataFrame | None = None) -> DataFrame:
    """file, block, place, text of every record. Its partitions and the rows in them keep the order in the files, which is
    also that of (file, block, place)."""
    pieces = _pieces(spark, path, grammar)
    states = _entries(_tables(pieces, grammar) if found is None else found, grammar).limit(BLOCKS + 1).collect()
    if len(states) > BLOCKS:
        raise ValueError(f"more than {BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    begin = spark.sparkContext.broadcast({(r.file, r.start): (r.state, r.level, r.base, r.began) for r in states})
    # some blocks that follow one another make a partition
    partitions = max(1, min(len(states), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(states) // BLOCKS_A_PARTITION)))
    slots = {key: at * partitions // len(states) for at, key in enumerate(sorted(begin.value))}
    slot_of = spark.sparkContext.broadcast(slots)
    types = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("text", pa.string()),
                       ("slot", pa.int32())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, []
        for file, start, piece, marked in _runs(batches, grammar.marks):
            if (file, start) != key:
                if held:
                        yield key[0], began, key[1], LAST, "".join(held), slot_of.value[key[0], began]
                key, held, place = (file, start), [], 0
                if key not in begin.value:
                    raise RuntimeError("the files were split otherwise than in the first pass; set spark.sql.files.minPartitionNum")
                state, level, base, began = begin.value[key]
            if marked:
                state, change = grammar.scan(piece, state)
                level += change
            held.append(piece + grammar.kept)
            if state == 0 and level == base:
                over = began != start  # its first part lies in an earlier block
                text = "".join(held)
                if text.strip():  # no blank lines
                    yield file, began, start, LAST if over else place, text, slot_of.value[file, began]
                    place += not over
                held, began = [], start
        if held:
            yield key[0], began, key[1], LAST, "".join(held), slot_of.value[key[0], began]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in records(batches):
            rows.append(row)
            size += len(row[4])
            if size >= FLUSH or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    parts = pieces.mapInArrow(run, "file string, block long, at long, place long, text string, slot int")
    # a record that runs over blocks has a row for each; they lie together now, as the order puts them
    dealt = parts.repartitionById(partitions, F.col("slot")).sortWithinPartitions("file", "block", "place", "at")
    joined = pa.schema([types.field(k) for k in ("file", "block", "place", "text")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            rows = []
            for file, block, place, text in zip(*(batch.column(k).to_pylist() for k in joined.names)):
                if (file, block, place) != key:
                    if key is not None:
                        rows.append((*key, "".join(held)))
                    key, held = (file, block, place), []
                held.append(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), joined)], schema=joined)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*key, "".join(held)), joined)], schema=joined)

    return dealt.mapInArrow(join, "file string, block long, place long, text string")


def spans_lines(spark: SparkSession, path: str | Sequence[str], grammar: Grammar) -> tuple[DataFrame, bool]:
    """The transition tables of the blocks, stored, and whether any record has more than one piece."""
    from ..functions.storage import stored

    tables = stored(_tables(_pieces(spark, path, grammar), grammar), "blocks")
    return tables, not tables.filter(~F.col("alone")).isEmpty()
