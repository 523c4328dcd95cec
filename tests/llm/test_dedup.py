"""Exact dedup, n-gram join, suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import components, exact_dedup, jaccard_join, suffix_array, suffix_dedup


def test_exact_groups(docs):
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), i is None, i or 0, i))
    expected = Counter()
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text)
        keep = min(groups[plain])[3]
        expected[(i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest())] += 1
    for support in (0.0005, 0.2):
        assert Counter(map(tuple, exact_dedup.exact_dedup(docs, support=support).collect())) == expected


def test_exact_drop(docs):
    kept = exact_dedup.drop_copies(docs)
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(set(texts))
    assert set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()}


def test_exact_heavy_group_is_not_shuffled(spark):
    rows = spark.range(30000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    out = exact_dedup.exact_dedup(rows)
    assert out.filter("group_size = 10000 AND keep_id = 0").count() == 10000 and out.count() == 30000
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("front", [True, False])
def test_exact_sketch_counts(spark, front):
    """A digest on a third of the rows is sketched, whether its rows come first in their partitions or are spread."""
    hot = "id % 10000 < 3333" if front else "id % 3 = 0"
    docs = spark.range(0, 60000, 1, 6).selectExpr("id AS doc_id", f"if({hot}, 'same', if(id % 100 = 99, 'often', cast(id AS string))) AS text")
    got = exact_dedup.frequent_digests(exact_dedup.fingerprints(docs)).collect()
    digests = [bytes(r.digest) for r in got]
    assert len(digests) == len(set(digests)) <= 2000
    assert {hashlib.sha256(x).digest() for x in (b"same", b"often")} <= set(digests)


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components_by_hand(rows: list[tuple], size: int, percent: int) -> dict:
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(parent, i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_join_components(docs, keyed, size, percent):
    expected = components_by_hand([(r.doc_id, r.text) for r in keyed.collect()], size, percent)
    rows = jaccard_join.similar_components(docs, size, percent).collect()
    assert len(rows) == docs.count()
    assert {r.id: (r.n_shingles, r.component) for r in rows if r.id is not None} == expected
    assert all(r.component is None for r in rows if r.id is None)


def test_join_groups_with_one_prefix(spark):
    """Many texts that differ only in frequent shingles share prefix and size; all must be verified."""
    rng = random.Random(2)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for k in range(30):
        tail = common[:]
        for _ in range(k % 5):
            a = rng.randrange(len(tail) - 1)
            tail[a], tail[a + 1] = tail[a + 1], tail[a]
        rows.append((k, " ".join([f"r{k % 3}x{j}" for j in range(12)] + tail)))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert {r.id: (r.n_shingles, r.component) for r in got.collect()} == components_by_hand(rows, 2, 80)


def test_join_drop(docs, keyed):
    kept = jaccard_join.drop_similar(docs, 5, 80)
    expected = components_by_hand([(r.doc_id, r.text) for r in keyed.collect()], 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()} | {None}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for link in links for x in link}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent if any(a != b and x in (a, b) for a, b in links)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 4))
def test_suffix_array(part, times):
    text = part * times + [0]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    got = suffix_array.suffix_array(np.array(text), 258)
    assert got.tolist() == order
    prefix = suffix_array.common_prefixes(np.array(text), got, 10)
    for a, b in zip(order, order[1:]):
        assert prefix[b] == next((k for k in range(11) if k == 10 or text[a + k:a + k + 1] != text[b + k:b + k + 1]), 10)


def lines_run(call) -> int:
    """Lines of our own code that a call executes: what is done one by one in Python shows here."""
    count = 0

    def trace(frame, event, arg):
        nonlocal count
        count += event == "line"
        return trace

    sys.settrace(trace)
    try:
        call()
    finally:
        sys.settrace(None)
    return count


def test_suffix_array_names_take_no_loop():
    """The many different names of a long text are sorted in numpy; the result is that of plain sorting."""
    rng = np.random.default_rng(5)
    part = rng.integers(1, 258, 2000)
    text = np.r_[rng.integers(1, 258, 9000), part, rng.integers(1, 258, 3000), part, part[:700], np.full(500, 7), 0]
    raw = text.astype(">u2").tobytes()
    order = suffix_array.suffix_array(text, 258)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: raw[2 * i:])
    short, long = (np.r_[x, 0] for x in (text[:4000], np.tile(text[:-1], 3)))
    assert lines_run(lambda: suffix_array.suffix_array(long, 258)) < 2 * lines_run(lambda: suffix_array.suffix_array(short, 258))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=50), st.integers(1, 5))
def test_suffix_order_of_names(part, times):
    text = part * times + [0]
    assert suffix_array._by_names(np.array(text), max(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_dedup_short_texts_together(monkeypatch):
    """Short texts are hashed together, with the stretches that each has alone, whatever lies beside it."""
    rng = random.Random(6)
    words = [rng.randbytes(rng.randrange(1, 9)) for _ in range(30)]
    texts = [b" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(400)] + [b"", b"a" * 99, b"a" * 100, b"a" * 350, b"ab" * 200]
    rng.shuffle(texts)
    alone = [(k, *row) for k, text in enumerate(texts) for found in suffix_dedup.stretches(text) for row in zip(*(x.tolist() for x in found))]
    assert {k for k, *_ in alone} == {k for k, text in enumerate(texts) if len(text) >= 100}
    calls, sums = [], suffix_dedup.sums
    monkeypatch.setattr(suffix_dedup, "sums", lambda text: calls.append(len(text)) or sums(text))
    for joined in (1, 1000, 1 << 17):
        calls.clear()
        monkeypatch.setattr(suffix_dedup, "JOINED", joined)
        together = [row for found in suffix_dedup.all_stretches(texts) for row in zip(*(x.tolist() for x in found))]
        assert together == alone
    assert len(calls) == 1


def removal_by_hand(rows: list[tuple], window: int) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k:k + window] in seen:
                gone[k:k + window] = b"\1" * window
            seen.add(b[k:k + window])
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("shard_bytes", "crowd"), [(1 << 20, 1024), (3000, 2), (1 << 20, 1)])
def test_suffix_dedup(keyed, shard_bytes, crowd):
    expected = removal_by_hand([(r.doc_id, r.text) for r in keyed.collect()], 100)
    rows = suffix_dedup.remove_repeats(keyed, shard_bytes=shard_bytes, crowd=crowd).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected


def test_suffix_dedup_parts(monkeypatch, keyed):
    """Texts longer than a part, and rows without an id or listed twice."""
    text = ("abcdefgh" * 300 + "".join(chr(97 + i * i % 23) for i in range(4000))).encode()
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.stretches(text))]
    monkeypatch.setattr(suffix_dedup, "PART", 1500)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.stretches(text))]
    assert whole[3].sum() == parts[3].sum() == len(text) - 99
    assert set(whole[0]) <= set(parts[0])


def test_suffix_dedup_defined_cases(docs):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count() and all(r.n_removed == 0 for r in rows if r.id is None)


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == jaccard_join.similar_components(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == exact_dedup.drop_copies(empty).count() == 0
