"""Sources and sinks on small files, and operators on cases that the catalogue's tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from rastrel.functions import scalars
from rastrel.operators import graph, overlay
from rastrel.sources import files


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": kind and {"type": kind, "coordinates": coordinates}}


SQUARE = [[0, 0, 5], [4, 0, 5], [4, 3, 5], [0, 3, 5], [0, 0, 5]]


def test_geojson_round_trip(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [feature("Polygon", [SQUARE], gml_id="a"), feature(None, None, gml_id="b"), feature("MultiPolygon", [[SQUARE], [SQUARE]], gml_id="c", n=7), feature("Point", [1, 2])]}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.geojson").write_text(json.dumps(collection))
    (tmp_path / "in" / "broken.json").write_text("{nothing")
    got = files.read_geojson(spark, str(tmp_path / "in")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.properties["gml_id"], len(r.polygons)) for r in got] == [(0, "a", 1), (2, "c", 2)]
    assert got[1].properties["n"] == "7"
    assert [tuple(p) for p in got[0].polygons[0][0]] == [(x, y) for x, y, _ in SQUARE]
    again = files.read_geojson(spark, str(tmp_path / "in")).select(F.col("properties")["gml_id"].alias("id"), "polygons")
    files.write_geojson_lines(again, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("*.txt"):
        part.rename(part.with_suffix(".geojsonl"))
    back = files.read_geojson(spark, str(tmp_path / "out"), lines=True)
    areas = back.select(F.col("properties")["id"].alias("id"), F.col("polygons")[0][0].alias("ring")).select("id", scalars.shoelace("ring").alias("area"))
    assert sorted(map(tuple, areas.collect())) == [("a", 12.0), ("c", 12.0)]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_geojson_lines(again, str(tmp_path / "out"))


def test_worldfiles(spark, tmp_path):
    (tmp_path / "a.jgw").write_text("2.0\n0\n0\n-2.0\n101.0\n199.0\n")
    (tmp_path / "a.wld").write_text("9\n9\n9\n9\n9\n9\n")
    (tmp_path / "b.wld").write_text("1\nx\n")
    got = {r.stem.rsplit("/", 1)[1]: r for r in files.read_worldfiles(spark, str(tmp_path)).collect()}
    assert (got["a"].a, got["a"].e, got["a"].c, got["a"].f) == (2.0, -2.0, 100.0, 200.0)
    assert got["b"].c is None


def test_labels_manifest_and_images(spark, tmp_path):
    for name, text in {"m.txt": "3 0.5 0.5\n1 0 0", "n.txt": "", "o.txt": "x 1"}.items():
        (tmp_path / name).write_text(text)
    assert sorted((r.stem, r.class_id) for r in files.read_class_labels(spark, str(tmp_path)).collect() if r.class_id is not None) == [("m", 3)]
    (tmp_path / "crops.csv").write_text('path,material\n/old/a.jpg,"roof, flat"\nB.png,\n')
    rows = files.read_manifest(spark, str(tmp_path / "crops.csv"))
    assert sorted(map(tuple, rows.collect()), key=str) == [("/old/a.jpg", "roof, flat"), ("B.png", None)]
    wanted = spark.createDataFrame([("/old/a.jpg", 1), ("B.png", 2), ("gone.jpg", 3), ("/r/c.tif", 4)], "path string, n int")
    listing = spark.createDataFrame([("/r/a.jpg",), ("/r/a.png",), ("/r/b.tif",), ("/r/c.tif",)], "file string")
    got = {r.n: r.image for r in files.resolve_images(wanted, listing, "/r/").collect()}
    assert got == {1: "/r/a.jpg", 2: "/r/b.tif", 3: None, 4: "/r/c.tif"}


def test_position_list(spark):
    rows = spark.createDataFrame([(1, "0 0 0  1 0 0\n1 1 1", None), (2, "0 0 1 1", None), (3, "0 0 1 0 1 1 0 1 2 2", None), (4, "0 0 0 1 0 0 1 1 q", 3), (5, None, None)], "n int, t string, d int")
    got = {r.n: r.p for r in rows.select("n", files.position_list("t", "d").alias("p")).collect()}
    assert [tuple(p) for p in got[1]] == [(0, 0, 0), (1, 0, 0), (1, 1, 1)]
    assert got[2] is got[3] is got[4] is got[5] is None


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 900]], "id long")
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {900: 900}
    assert graph.components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_zero_probabilities_and_ties(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = rows.select(overlay.averaged(["a", "b"], [1.0, 1.0]).alias("p")).select("p", overlay.first_best(F.col("p")).alias("k")).collect()
    assert sorted((r.p, r.k) for r in got) == [([0.0, 0.0], 0), ([0.5, 0.5], 0)]
