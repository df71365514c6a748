"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, written

MAX_ROUNDS = 60


def large_star(now: DataFrame) -> DataFrame:
    """Links of each node's greater neighbours to the least of it and its neighbours. As edges grow with the input, no side of a join is broadcast."""
    both = now.union(now.select("v", "u"))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.hint("merge").join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(large: DataFrame) -> DataFrame:
    """Links of each node and its lesser neighbours to the least of them."""
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.hint("merge").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of edges (u, v), both long: root is the smallest node it reaches.

    Each round is two grouped minima and two joins on node, written to the shared folder, so that
    lineage stays short and nothing is gathered on the driver but counts. It ends when a round changes no edge,
    which an anti-join tells. Loops are ignored; an empty edge table gives no rows. Rounds grow as the square of a logarithm of the longest path.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = now.count()
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        large = written(large_star(now), "large")
        after = written(small_star(large), "small")
        drop_written(large)
        n_after = after.count()
        settled = n_after == n and after.hint("merge").join(now, ["u", "v"], "left_anti").isEmpty()
        drop_written(now)
        now, n = after, n_after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
