"""Bottom-k near copies against comparing every two sets."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import bottom_k

from .conftest import SCHEMA, prose


def shingles(text: str | None, size: int) -> frozenset:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    width = min(size, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows: list[tuple], size: int, percent: int) -> dict:
    sets = {r[0]: shingles(r[1], size) for r in rows if r[0] is not None}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                least[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def cloud(seed: int = 11) -> list[tuple]:
    """Many versions of few pages, so that similarities lie on both sides of the threshold; a line that half of them share."""
    rng = random.Random(seed)
    line, out = prose(rng, 12), []
    for family in range(3):
        words = prose(rng, (90, 400, 700)[family]).split()
        for _ in range(70):
            edited = words[:]
            for _ in range(rng.randrange(0, len(words) // 12)):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(10 ** 6)}"
            out.append(" ".join(edited) + (" " + line if rng.random() < 0.5 else ""))
    out += [prose(rng, 30) + "\n" + line for _ in range(80)]
    rng.shuffle(out)
    return [(3 * k + 1, t, "en", "a", 1, *"xyzwvuts") for k, t in enumerate(out)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_of_the_fixture(docs, fixture_rows, size, percent):
    found = bottom_k.near_duplicates(docs, size, percent).collect()
    assert len(found) == len(fixture_rows)
    want = brute(fixture_rows, size, percent)
    for r in found:
        if r.id is not None:
            assert (r.n_shingles, r.component) == want[r.id] and r.kept == (r.id == r.component)
        else:
            assert r.component is None and r.kept


@pytest.mark.parametrize("k,lists,block", [(bottom_k.K, bottom_k.LISTS, bottom_k.BLOCK), (bottom_k.K, bottom_k.LISTS, 5), (128, 64, 20)])
def test_components_of_near_copies(spark, monkeypatch, k, lists, block):
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    monkeypatch.setattr(bottom_k, "COLUMNS", 100)
    rows = cloud()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = bottom_k.similar_components(df, 3, 85, k=k, lists=lists)
    assert {r.id: (r.n_shingles, r.component) for r in found.collect()} == brute(rows, 3, 85)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "BROADCAST_IDS", 3)
    rows = cloud(3)[:120]
    found = bottom_k.similar_components(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 85)
    assert {r.id: (r.n_shingles, r.component) for r in found.collect()} == brute(rows, 3, 85)


def test_text_ids(spark):
    rows = [(f"d{r[0]}", *r[1:]) for r in cloud(5)[:60]]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    assert {r.id: (r.n_shingles, r.component) for r in bottom_k.similar_components(df).collect()} == brute(rows, 3, 85)


def test_empty_table(empty):
    assert bottom_k.near_duplicates(empty).collect() == []


def test_least_common_bounds_every_pair(spark):
    """The formula stays below what simulated similar pairs share."""
    rng = random.Random(6)
    for n, m in [(40, 46), (64, 64), (70, 80), (250, 260), (1000, 1100), (3000, 3000)]:
        union = (n + m) * 100 // 185
        common = n + m - union
        need = spark.range(1).select(bottom_k.least_common(F.lit(min(n, m)), F.lit(float(union)), 64, 85)).first()[0]
        for _ in range(200):
            low = sorted(rng.sample(range(10 ** 6), union))
            shared = set(rng.sample(low, common))
            assert sum(v in shared for v in low[:64]) >= need
