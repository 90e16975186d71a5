"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join with one row per key on
its right side, so that adaptive execution may split a hub's rows.  No component is ever in one
task.  The edge table is stored after each round; rounds grow with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import Store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, store: Store) -> DataFrame:
    """``(u, v)`` of bigint -> ``(u, v)`` with v the smallest vertex of u's component; one row for
    every vertex that is not itself the smallest.  Loops and repeated edges are allowed, an empty
    table gives an empty table."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = store.put(edges.select("u", "v").where("u != v").distinct(), "star0")
    before, turn = state(now), 0
    while before[0]:
        turn += 1
        now = store.put(_small_star(_large_star(now)), f"star{turn}")
        after = state(now)
        store.drop(f"star{turn - 1}")
        if after == before:
            break
        before = after
    return now
