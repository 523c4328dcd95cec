"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.storage import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (a, b).

    Each round every node passes its smallest neighbour on to its larger neighbours, then to all of its smaller ones;
    links become stars around the smallest id in a number of rounds that grows with the logarithm of the longest path.
    Minima combine before the shuffle; the join with them leaves the links of a very large node to adaptive execution,
    which splits a skewed partition. More ``rounds`` than allowed raise an error.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stored(large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).filter("u <> v")
                       .unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = small.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(small, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
