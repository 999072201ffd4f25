"""GeoPackage files written and read again."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from rastrel.functions import scalars
from rastrel.sources import geopackage, geotiff


def test_round_trip(spark, tmp_path):
    square = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]]
    rows = [("a", 1, "x'\"", 1.5, square), ("a", 2, None, None, square + square), ("b", 3, "z", 2.0, square), ("b", 4, "z", 2.0, None), (None, 5, "z", 2.0, square)]
    table = spark.createDataFrame(rows, "part string, n int, name string, v double, polygons array<array<array<struct<x:double,y:double>>>>")
    assert geotiff.save_files(geopackage.encode_layers(table, "part", "roofs", 32632), str(tmp_path)) == 2
    con = sqlite3.connect(tmp_path / "a.gpkg")
    assert con.execute("pragma application_id").fetchone()[0] == geopackage.APPLICATION and con.execute("select count(*) from roofs").fetchone() == (2,)
    back = geopackage.read_layer(spark, str(tmp_path), "roofs").withColumn("area", scalars.polygons_area("polygons"))
    got = {r.properties["n"]: r for r in back.collect()}
    assert sorted(got) == ["1", "2", "3"] and got["1"].area == 15.5 and got["2"].area == 31 and got["1"].epsg == 32632
    assert got["1"].properties["name"] == "x'\"" and got["2"].properties["name"] is None and got["2"].properties["v"] is None
    assert geopackage.read_layer(spark, str(tmp_path)).where(F.col("file").endswith("b.gpkg")).count() == 1
    with pytest.raises(Exception, match="no layer"):
        geopackage.read_layer(spark, str(tmp_path), "walls").collect()


def test_kinds_of_geometry():
    ring = struct.pack(">I", 3) + struct.pack(">9d", 0, 0, 7, 1, 0, 7, 1, 1, 7)
    body = struct.pack(">BII", 0, 1003, 1) + ring
    assert geopackage.polygons_of(b"GP\0\3" + b"\0" * 4 + b"\0" * 32 + body) == [[[{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]]]
    assert geopackage.polygons_of(None) is None and geopackage.polygons_of(b"GP\0\x11" + b"\0" * 9) is None
    assert geopackage.polygons_of(b"GP\0\1" + b"\0" * 4 + struct.pack("<BI2d", 1, 1, 2, 3)) is None
