"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from millrace.llm import conversation_repair
from millrace.llm.conversation_repair import damage, repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("conv", T.StringType()),
    T.StructField("seal", T.IntegerType()), T.StructField("kind", T.IntegerType())])
WHITE = " \t\n\x0b\x0c\r"
FOLLOW = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def conversations(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in range(260):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "Ändern"])
            text = rng.choice(["Well.", "well", "Right! ", "so?\n", "", " \t", None, "ü. é", "no. end ", "x" * 50 + "."])
            out.append((c, turn if rng.random() < 0.9 else rng.choice([None, turn + 3, -2]), role, text))
    out += out[5:9] + [(None, k, r, "t.") for k, r in enumerate(["user", "assistant", "user"])]
    out += [(2 ** 60 + 1, 2 ** 60 + 3, "user", "a."), (2 ** 60 + 1, 2 ** 60 + 1, "user", "b."), (900, None, "assistant", "only.")]
    return [(*r, "x", "y", 1, 2) for r in out]


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows: list[tuple]) -> dict:
    """Counts, and the cheapest edits by trying them all from every place on."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]

    @lru_cache(maxsize=None)
    def best(at: int, state: int, inserts: int) -> tuple:
        ways = []
        if at == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        if inserts < 4:
            role = "a" if state == 2 else "u"
            cost, audit, lines = best(at, FOLLOW[state, role], inserts + 1)
            ways.append((cost + 2, "I" + audit, ({"u": "user", "a": "assistant"}[role] + ":", *lines)))
        if at < len(rows):
            _, _, role, text = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[at] not in ("blank", "duplicate"):
                for edit, name, price in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                    if (state, name[:1]) in FOLLOW:
                        cost, audit, lines = best(at + 1, FOLLOW[state, name[:1]], 0)
                        ways.append((cost + price + (faults[at] == "truncated"), edit + audit, (f"{name}:{text}", *lines)))
        return min(ways, default=(10 ** 9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def expected(rows: list[tuple]) -> dict:
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    return {c: brute([(a, b, " " if d is None else d, " " if e is None else e) for a, b, d, e in v]) for c, v in by.items()}


def found(df) -> dict:
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv"] for r in rows}) == len(rows)
    return {r.pop("conv"): r for r in rows}


@pytest.fixture(scope="module")
def rows():
    return conversations()


def test_damage_follows_the_hash(spark, rows):
    df = damage(spark.createDataFrame(rows, SCHEMA).repartition(4))
    key = lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(damaged(rows), key=key)


@pytest.mark.parametrize("hurt", [False, True])
def test_repair_is_the_cheapest_and_least(spark, rows, hurt):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = found(repair(damage(df), conv_col="conv") if hurt else repair(df))
    assert out == expected(damaged(rows) if hurt else rows)


def test_long_conversation_spills_its_pointers(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}.", ""]), "", "", 0, 0) for c in (1, 2) for k in range(400)]
    sys.setrecursionlimit(20000)
    monkeypatch.setattr(conversation_repair, "HELD", 64)
    monkeypatch.setattr(conversation_repair, "READ", 7)
    assert found(repair(spark.createDataFrame(rows, SCHEMA).repartition(7))) == expected(rows)


def test_one_conversation_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = conversations(9)[:200]
        assert found(repair(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table(spark):
    assert repair(damage(spark.createDataFrame([], SCHEMA)), conv_col="conv").collect() == []


def test_query_lists_conversations_without_rows(spark, tmp_path):
    from millrace.llm.queries import QUERIES

    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    out = [r.asDict() for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()]
    want = expected(damaged(rows))
    lost = {r[0] for r in rows} - set(want)
    assert lost
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert {r.pop("conv_id"): r for r in out} == want | dict.fromkeys(lost, none)
