"""Polygons on grids against a brute-force sampling."""

import pytest
from pyspark.sql import functions as F

from rastrel.functions import scalars
from rastrel.operators import rasterize

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"
TRIANGLE = [[[(1.0, 1.0), (9.0, 2.5), (3.5, 8.0), (1.0, 1.0)]]]
RING = [[[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]]]
TWO = [[[(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]], [[(5.0, 5.0), (7.0, 5.0), (7.0, 7.0), (5.0, 7.0)]]]


def holds(polygons, x, y):
    def odd(ring):
        edges = zip(ring, ring[1:] + ring[:1], strict=True)
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in edges) % 2

    return any(sum(map(odd, p)) % 2 for p in polygons)


def touches(polygons, r, c, n=40):
    inside = any(holds(polygons, c + (i + 0.5) / n, r + (j + 0.5) / n) for i in range(n) for j in range(n))
    return inside


@pytest.fixture(scope="module")
def zones(spark):
    rows = [(1, TRIANGLE), (2, RING), (3, TWO), (4, None), (5, []), (6, [[[(1.0, 1.0), (2.0, 2.0)]]])]
    return spark.createDataFrame(rows, f"id long, polygons {POLYGONS}")


def test_cells(zones):
    for touched in (False, True):
        got = {(x.id, x.r, x.c) for x in rasterize.cells(zones, 9, 9, touched).collect()}
        shapes = {1: TRIANGLE, 2: RING, 3: TWO}
        expected = {(i, r, c) for i, s in shapes.items() for r in range(9) for c in range(9) if (touches(s, r, c) if touched else holds(s, c + 0.5, r + 0.5))}
        assert got == expected


def test_fractions_and_zonal(spark, zones):
    at = (10.0, 0.0, 100.0, 0.0, -10.0, 500.0)
    world = zones.withColumn("polygons", scalars.moved("polygons", lambda x, y: (100 + 10 * x, 500 - 10 * y)))
    got = {(x.r, x.c): x.fraction for x in rasterize.fractions(world.where("id in (2, 3)"), at, 9, 9).collect()}
    assert got[0, 0] == got[5, 5] == 1 and (3, 3) not in got
    assert (8, 8) not in got and max(got.values()) == 1
    alone = {(x.r, x.c): x.fraction for x in rasterize.fractions(world.where("id = 3"), at, 9, 9).collect()}
    assert alone[0, 0] == 1.0 and len(alone) == 5  # a quarter of each side is touched by a box from 0.2 to 0.8
    assert {x.fraction for x in rasterize.fractions(world.where("id = 3"), at, 9, 9, supersample=1, all_touched=True).collect()} == {1.0}
    pixels = spark.createDataFrame([(r, c, float(r)) for r in range(9) for c in range(9)], "r int, c int, v double")
    means = {x.id: x.m for x in rasterize.zonal(pixels, world, at, 9, 9).groupBy("id").agg(F.avg("v").alias("m")).collect()}
    assert means[2] == 3.5 and means[3] == pytest.approx((0 + 5 + 5 + 6 + 6) / 5)
    areas = {x.id: x.a for x in zones.select("id", scalars.polygons_area("polygons").alias("a")).collect()}
    assert areas[2] == 48 and areas[3] == pytest.approx(4.36) and areas[1] == 26.125 and areas[4] is None and areas[5] == 0
