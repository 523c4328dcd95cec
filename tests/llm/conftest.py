from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and stone river cloud winter table green open seven letter garden music window paper silver bridge morning".split()
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("_lost", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("document", T.StringType()), T.StructField("rate", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows, ties."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 160)) for _ in range(60)]
    texts += [None, None, "", " \n\t", "one", "one two", "One  TWO", "é ü ß", "日本 語", "12 34", "x" * 5000]
    texts += [texts[3], texts[3].replace(" ", "  "), texts[3].upper(), texts[3]]
    family = prose(rng, 200).split()
    for k in range(25):  # near copies of one another, to different degrees
        edited = family[:]
        for _ in range(k // 4):
            edited[rng.randrange(len(edited))] = f"edit{rng.randrange(10 ** 6)}"
        texts.append(" ".join(edited))
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 40)}" for _ in range(8)]
    texts += [passage + " " + passage, prose(rng, 9) * 40, prose(rng, 30000)]
    out = [(i * 7 % 997 + 1, t, ("en", "de", None)[i % 3], (None, "b", "a", "ä")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    out += [out[10], out[62], (None, texts[3], "en", "a", 1), (None, None, None, None, None)]
    return [(*r, "x", "y", "z", "w", "v", "u", "t", "s") for r in out]


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def keyed(spark, fixture_rows):
    """Each document once, and each with an id."""
    once = {r[0]: r for r in fixture_rows if r[0] is not None}
    return spark.createDataFrame(list(once.values()), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
