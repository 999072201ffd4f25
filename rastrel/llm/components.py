"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _minimum_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours. The minimum is combined before the shuffle, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minimum_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps, which end after a logarithmic number of rounds in a forest of
    stars around the minima. Each round is written to the shared checkpoint folder. Loops and repeated edges are
    allowed; an empty edge table gives an empty result; null ends are ignored.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
        seen = mark
        state = cut(_small_star(_large_star(state)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
