"""Spelling variant grouping: words one edit apart, by products of letter-count blocks.

1. Words are counted per task and added up.
2. A word's cell is its length and its number of letters of each of three classes (by code point). One edit changes
   these by one step, so a word meets only the words of its own and of the neighbouring cells of its own and the
   adjacent length. Cells are cut into blocks of bounded size.
3. A task takes two blocks, counts the letters of their words into two matrices, and one matrix product gives all
   squared distances. An edit moves them by at most two; pairs within that are verified letter by letter.
4. A word's form is its most frequent near word, if that is ``factor`` times as frequent; following the forms (each
   step multiplies the frequency, so there are few) leads to the root.

Defined cases: a null or empty text has no words; rows with one id are texts of their own, as is a row without an id;
repeated rows count again; among equally frequent near words the smallest in code-point order is the form; an empty
table gives an empty result; other columns are ignored. Texts and words may have any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.storage import stored

#: Words that a task holds before it passes its counts on.
HELD = 200_000
#: Letters of a block: 2048 words of 16 letters, fewer longer ones, at least one.
BLOCK = 2048 * 16
#: Candidate pairs that are verified at a time, in letters.
CHUNK = 1 << 22
#: Letters of the words: a to z and U+00C0 to U+00FF, in three classes that an edit moves between.
ALPHABET = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
CLASSES = ["".join(a for a in ALPHABET if ord(a) % 3 == k) for k in range(3)]
#: Steps of (length, letters of the first class, of the second) to the cells of near words, each pair of cells once.
STEPS = [(0, 0, 0), (0, 1, -1), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0)]


def slip(length: int, h: int) -> int | None:
    """Where the word query deletes a code point of a run of this length, given the run's hash; mostly nowhere."""
    return h % length if h % 199 == 0 else None


def word_counts(docs: DataFrame, least_length: int = 6, least_n: int = 5, slip: Callable[[int, int], int | None] | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the maximal runs of letters in all texts, with A-Z in lower case.

    ``slip(length, crc32 of "<id>:<run>")`` may name a code point to delete from a run before it is counted.
    """
    source = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).cast("binary").alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length)).findall  # a run can only get shorter
        counts: dict[str, int] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(find((text.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                    if slip is not None and (at := slip(len(word), zlib.crc32(word.encode(), start))) is not None:
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)
                    counts = {}
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    found = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_n)


def _codes(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A row for each word: how often it has each of the letters."""
    n, length = codes.shape
    spots = np.arange(n)[:, None] * len(letters) + np.searchsorted(letters, codes)
    counts = np.bincount(spots.ravel(), minlength=n * len(letters)).reshape(n, len(letters))
    return counts.astype(np.float32 if length < 1000 else np.float64)  # products are exact


def near_pairs(left: list[str], right: list[str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in two lists (or twice in one) of distinct words, each list of one length, of words one edit apart.

    The words of ``right`` are as long as those of ``left``, or longer by one.
    """
    a = _codes(left, len(left[0]))
    b = a if right is None else _codes(right, len(right[0]))
    letters = np.union1d(a, b)
    x = _letter_counts(a, letters)
    y = x if right is None else _letter_counts(b, letters)
    distance = x @ y.T
    distance *= -2
    distance += (x * x).sum(1)[:, None]
    distance += (y * y).sum(1)[None]
    i, j = np.nonzero(distance <= 2)
    if right is None:
        i, j = i[i < j], j[i < j]
    length = a.shape[1]
    step = max(1, CHUNK // max(1, length))
    for at in range(0, len(i), step):
        p, q = i[at:at + step], j[at:at + step]
        if b.shape[1] == length:
            near = (a[p] != b[q]).sum(1) == 1
        else:  # what is before the inserted letter and what is behind it cover the shorter word
            before = np.logical_and.accumulate(a[p] == b[q, :length], axis=1).sum(1)
            behind = np.logical_and.accumulate(a[p, ::-1] == b[q, :0:-1], axis=1).sum(1)
            near = before + behind >= length
        yield p[near], q[near]


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple[list[str], list[int]]]]]:
    """For each run of rows of one task (task, alone, side, word, n): alone, and words and counts of both sides."""
    task, alone, sides = None, False, [([], []), ([], [])]
    for batch in batches:
        for t, a, side, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if t != task:
                if task is not None:
                    yield alone, sides
                task, alone, sides = t, a, [([], []), ([], [])]
            sides[side][0].append(word)
            sides[side][1].append(n)
    if task is not None:
        yield alone, sides


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n of every two words (word, n; each word once) that differ by one edit, in both directions."""
    cell = ["length", "c0", "c1"]
    placed = words.select("word", "n", F.length("word").alias("length"), *[
        (F.length("word") - F.length(F.translate("word", letters, ""))).alias(f"c{k}") for k, letters in enumerate(CLASSES[:2])])
    cells = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) * F.greatest("length", F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = stored(cells, "cells")
    blocks = placed.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))

    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(s)]) for s in STEPS]))
    pairs = (cells.withColumn("step", steps).withColumns({f"to_{c}": F.col(c) + F.col(f"step.d{k}") for k, c in enumerate(cell)}).drop("step"))
    pairs = pairs.join(cells.select(*[F.col(c).alias(f"to_{c}") for c in cell], F.col("blocks").alias("to_blocks")), [f"to_{c}" for c in cell])
    same = (F.col("length") == F.col("to_length")) & (F.col("c0") == F.col("to_c0")) & (F.col("c1") == F.col("to_c1"))
    tasks = (pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("to_block", F.explode(F.sequence(F.when(same, F.col("block")).otherwise(0), F.col("to_blocks") - 1)))
             .withColumn("task", F.concat_ws(":", *cell, "block", *[f"to_{c}" for c in cell], "to_block"))
             .withColumn("alone", same & (F.col("block") == F.col("to_block"))))
    sides = tasks.select("task", "alone", *cell, "block", F.lit(0).alias("side")).unionAll(
        tasks.filter(~F.col("alone")).select("task", "alone", *[f"to_{c}" for c in cell], "to_block", F.lit(1)))
    dealt = blocks.drop("blocks").join(sides, [*cell, "block"])
    dealt = dealt.select("task", "alone", "side", "word", "n").repartition("task").sortWithinPartitions("task", "side")
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, sides in _by_task(batches):
            (left, left_n), (right, right_n) = sides[0], sides[0] if alone else sides[1]
            if left and right:
                for i, j in near_pairs(left, None if alone else right):
                    word, near = [left[k] for k in i], [right[k] for k in j]
                    n = [left_n[k] for k in i], [right_n[k] for k in j]
                    yield pa.RecordBatch.from_arrays([pa.array(word + near, pa.string()), pa.array(near + word, pa.string()),
                                                      pa.array(n[1] + n[0], pa.int64())], schema=schema)

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n; each word once)."""
    if factor <= 1:
        raise ValueError("factor must be above 1: forms must be more frequent than their variants")
    words = stored(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    found = stored(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    most = found.agg(F.max("n")).first()[0] or 1
    jumps = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log(most, factor)) + 1))):  # each step of a chain multiplies n by the factor
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumps = stored(jumps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    return found.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
