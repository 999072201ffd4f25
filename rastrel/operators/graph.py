"""Components of graphs given as edge tables, and the operators that rest on them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import near_cells


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder; a temporary one is set only where the session names none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rastrel-"))
    return df.checkpoint(eager=True)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; minima are combined before the shuffle, so a hub costs a row a task."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """nodes(id) with component, the smallest id that edges(a, b) reach; a node without edges is its own."""
    state, seen = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(most_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            found = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return nodes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        seen, state = mark, cut(_round(state))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def dedup_within(points: DataFrame, distance: float, area: str = "area") -> DataFrame:
    """The largest of each group of points(id, x, y, area) that chains of at most `distance` link; the smallest id wins ties.

    Points of one cell are all near, so each is linked to its cell's smallest id alone, and two cells by one link: links grow
    with the points, never with the pairs.
    """
    first, links = near_cells(points, distance)
    grouped = components(points, first.union(links))
    largest = F.struct(F.col(area).isNull(), ~F.isnan(area), -F.col(area), F.col("id"))
    best = grouped.groupBy("component").agg(F.min_by(F.struct(*points.columns), largest).alias("best"))
    return best.select("best.*", "component")


def drop_islands(classes: DataFrame, width: int, least: int, default: int) -> DataFrame:
    """classes(r, c, k) where 4-connected regions under `least` pixels of another class become `default`."""
    other = classes.where(F.col("k") != default).select("k", (F.col("r").cast("long") * width + F.col("c")).alias("id"), "r", "c")
    right = other.where(F.col("c") < width - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), "k")
    down = other.select(F.col("id").alias("a"), (F.col("id") + width).alias("b"), "k")
    edges = right.union(down).join(other.select(F.col("id").alias("b"), "k"), ["b", "k"]).select("a", "b")
    grouped = components(other, edges)
    small = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < least)
    gone = grouped.join(small, "component", "left_semi").select("r", "c", F.lit(True).alias("gone"))
    return classes.join(gone, ["r", "c"], "left").withColumn("k", F.when(F.col("gone"), default).otherwise(F.col("k"))).drop("gone")


def drop_small_regions(classes: DataFrame, least: int) -> DataFrame:
    """classes(chip, r, c, k, default) where 4-connected regions of a chip under `least` pixels of another class become its default."""
    other = classes.where(F.col("k") != F.col("default")).select("chip", "r", "c", "k", F.struct("chip", "r", "c").alias("id"))
    right = other.select("chip", F.col("r").alias("r"), (F.col("c") + 1).alias("c"), "k", F.col("id").alias("a"))
    down = other.select("chip", (F.col("r") + 1).alias("r"), F.col("c").alias("c"), "k", F.col("id").alias("a"))
    edges = right.union(down).join(other.select("chip", "r", "c", "k", F.col("id").alias("b")), ["chip", "r", "c", "k"]).select("a", "b")
    grouped = components(other, edges)
    small = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < least)
    gone = grouped.join(small, "component", "left_semi").select("chip", "r", "c", F.lit(True).alias("gone"))
    return classes.join(gone, ["chip", "r", "c"], "left").withColumn("k", F.when(F.col("gone"), F.col("default")).otherwise(F.col("k"))).drop("gone")
