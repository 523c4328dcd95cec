"""Spelling variants against comparing every two words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling
from millrace.llm.queries import QUERIES


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts: dict[str, int], factor: int = 5) -> dict:
    form, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
        out[w] = (form[w], n, len(others), counts[form[w]] if form[w] else None)
    for w, (f, *rest) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, *rest)
    return out


def words_of(rows: list[tuple], slips: bool) -> dict[str, int]:
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def texts(seed: int = 8) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÀo") for _ in range(rng.randrange(5, 12))) for _ in range(25)] + ["Listen", "silent", "ÉCOLIER", "x" * 40, "aaaaaa"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 200])
        for _ in range(5):
            at = rng.randrange(len(w))
            words += [rng.choice([w[:at] + w[at + 1:], w[:at] + "e" + w[at:], w[:at] + "ö" + w[at + 1:], w[:at] + w[at:][::-1]])] * rng.choice([1, 5, 6, 40])
    rng.shuffle(words)
    out = [(k, rng.choice([" ", ", ", "1", "\n"]).join(words[k::60])) for k in range(60)]
    return out + [(None, "abcdef " * 9), (70, None), (71, ""), (72, "listen " * 30000), out[3], out[3]]


@pytest.fixture(scope="module")
def rows():
    return texts()


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)


@pytest.mark.parametrize("slips", [False, True])
def test_counts(spark, rows, slips):
    found = spelling.word_counts(table(spark, rows), slip=spelling.slip if slips else None)
    assert {r.word: r.n for r in found.collect()} == words_of(rows, slips)


def test_counts_are_passed_on_early(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {r.word: r.n for r in spelling.word_counts(table(spark, rows)).collect()} == words_of(rows, False)


@pytest.mark.parametrize("block", [spelling.BLOCK, 30])
def test_variants(spark, rows, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "CHUNK", 50)
    found = [tuple(r) for r in spelling.spelling_variants(spelling.word_counts(table(spark, rows))).collect()]
    want = brute(words_of(rows, False))
    assert len(found) == len(want) and {r[0]: r[1:] for r in found} == want
    assert any(r[1] for r in found) and any(r[4] > 2 for r in found)


def test_any_words(spark):
    """Words of other letters, very long ones, chains of forms, ties."""
    long = "ab" * 3000
    counts = {"привет": 6, "приветы": 40, "припет": 3, long: 9, long + "c": 100, long[1:]: 2, "aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125,
              "aabbbb": 625, "abbbbb": 3125, "aaaaac": 5, "z": 3, "y": 15, "": 2}
    found = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute(counts)


def test_factor_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(none, factor=1)


def test_near_pairs_match_all_pairs():
    rng = random.Random(1)
    for length in (1, 2, 7):
        left, right = (sorted({"".join(rng.choice("abc") for _ in range(n)) for _ in range(80)}) for n in (length, length + 1))
        for other in (None, right):
            pairs = {(int(i), int(j)) for p in spelling.near_pairs(left, other) for i, j in zip(*p)}
            both = left if other is None else other
            assert pairs == {(i, j) for i, a in enumerate(left) for j, b in enumerate(both) if near(a, b) and (other is not None or i < j)}


def test_query(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute(words_of(rows, True))
