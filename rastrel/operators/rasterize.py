"""Cells that polygons cover, on a grid of unit cells; polygons are arrays of rings of struct<x, y> in columns and rows of the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import moved


def on_grid(polygons: Column | str, transform: tuple[float, ...], times: int = 1) -> Column:
    """Polygons in columns and rows of a grid without rotation, whose cells are cut `times` times."""
    a, _, c, _, e, f = transform
    return moved(polygons, lambda x, y: ((x - c) / a * times, (y - f) / e * times))


def _columns(first: Column, last: Column, width: int) -> Column:
    """Columns of the frame from first to last; null for none."""
    first, last = F.greatest(F.lit(0), first.cast("int")), F.least(F.lit(width - 1), last.cast("int"))
    return F.when(last >= first, F.sequence(first, last))


def _edges(ring: Column, make) -> Column:
    """make(p, q) of each edge of a ring, nulls left out."""
    n = F.size(ring)
    return F.filter(F.transform(ring, lambda p, i: make(p, F.get(ring, (i + 1) % n))), lambda x: x.isNotNull())


def _held(polygon: Column, y: Column, width: int) -> Column:
    """Arrays of the columns whose centres at height y lie in an odd number of a polygon's rings: every second gap of its crossings."""
    crossing = lambda p, q: F.when((p["y"] > y) != (q["y"] > y), p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]))
    xs = F.array_sort(F.flatten(F.transform(polygon, lambda ring: _edges(ring, crossing))))
    gap = lambda x, i: F.when(i % 2 == 0, _columns(F.ceil(x - 0.5), F.ceil(F.get(xs, i + 1) - 0.5) - 1, width))
    return F.filter(F.transform(xs, gap), lambda span: span.isNotNull())


def _crossed(ring: Column, r: Column, width: int) -> Column:
    """Arrays of the columns of row r through whose insides an edge of a ring runs."""

    def part(p: Column, q: Column) -> Column:
        low, high = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
        at = lambda y: F.when(q["y"] == p["y"], p["x"]).otherwise(p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]))
        ends = [F.when(low == high, p["x"]).otherwise(at(F.greatest(low, r))), F.when(low == high, q["x"]).otherwise(at(F.least(high, r + 1)))]
        return F.when((low < r + 1) & (high > r), _columns(F.floor(F.least(*ends)), F.ceil(F.greatest(*ends)) - 1, width))

    return _edges(ring, part)


def cells(zones: DataFrame, height: int, width: int, all_touched: bool = False) -> DataFrame:
    """zones(polygons, ...) without polygons, once for each cell (r, c) of the frame whose centre a polygon holds, or that it touches.

    A polygon is dealt out by row, and a row's columns follow from the crossings of its edges, so the cost is rows times
    corners and the cells found, not the bounding box. Null and empty polygons, and rings of fewer than three points, cover nothing.
    """
    polygons = F.transform("polygons", lambda polygon: F.filter(polygon, lambda ring: F.size(ring) >= 3))
    rows = zones.withColumn("polygons", polygons)
    ys = F.transform(F.flatten(F.flatten("polygons")), lambda p: p["y"])
    rows = rows.withColumns({"_y0": F.greatest(F.lit(0.0), F.floor(F.array_min(ys))).cast("int"), "_y1": F.least(F.lit(float(height)), F.ceil(F.array_max(ys))).cast("int") - 1})
    rows = rows.withColumn("r", F.explode(F.when(F.col("_y1") >= F.col("_y0"), F.sequence("_y0", "_y1"))))
    spans = F.flatten(F.transform("polygons", lambda polygon: _held(polygon, F.col("r") + 0.5, width)))
    if all_touched:
        spans = F.concat(spans, F.flatten(F.transform(F.flatten("polygons"), lambda ring: _crossed(ring, F.col("r"), width))))
    return rows.withColumn("c", F.explode(F.array_distinct(F.flatten(spans)))).drop("polygons", "_y0", "_y1")


def fractions(zones: DataFrame, transform: tuple[float, ...], height: int, width: int, supersample: int = 4, all_touched: bool = False) -> DataFrame:
    """(r, c, fraction) of cells that zones(polygons) cover: the share of finer cells touched, each counted once; 1 for whole cells
    if `all_touched` or without finer ones."""
    whole = all_touched or supersample <= 1
    times = 1 if whole else supersample
    shapes = zones.select(on_grid("polygons", transform, times).alias("polygons"))
    covered = cells(shapes, height * times, width * times, all_touched=all_touched or not whole).select("r", "c").distinct()
    coarse = [F.floor(F.col(x) / times).cast("int").alias(x) for x in "rc"]
    return covered.groupBy(*coarse).agg((F.count("*") / (times * times)).alias("fraction"))


def zonal(pixels: DataFrame, zones: DataFrame, transform: tuple[float, ...], height: int, width: int, all_touched: bool = False) -> DataFrame:
    """Rows of zones(polygons, ...), without polygons, with the pixels(r, c, ...) they cover."""
    return cells(zones.withColumn("polygons", on_grid("polygons", transform)), height, width, all_touched).join(pixels, ["r", "c"])
