"""OpenStreetMap answers, CityGML roofs, UTM coordinates and rings on small cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rastrel.functions import scalars
from rastrel.operators import graph, spatial
from rastrel.sources import citygml, osm


def line(*pairs):
    return [{"lon": x, "lat": y} for x, y in pairs]


def test_overpass(spark, tmp_path):
    way = {"type": "way", "id": 1, "tags": {"roof:material": "Tar-Paper", "roof:shape": "flat"}, "geometry": line((0, 0), (4, 0), (4, 4))}
    again = way | {"tags": {"roof:material": "glass", "roof:shape": "flat"}}
    short = {"type": "way", "id": 2, "geometry": line((0, 0), (1, 1))}
    square, hole, far = line((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), line((2, 2), (3, 2), (3, 3)), line((20, 20), (30, 20), (30, 30))
    members = [{"type": "way", "role": "outer", "geometry": square}, {"type": "way", "role": "inner", "geometry": hole}, {"type": "way", "role": "", "geometry": far}, {"type": "node", "role": "outer"}]
    relation = {"type": "relation", "id": 1, "tags": {"roof:greening": "Yes"}, "members": members}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [way, again, short, relation, {"type": "relation", "id": 3, "members": members[1:2]}]}))
    (tmp_path / "b.json").write_text("{}")
    got = {(r.osm_type, r.osm_id): r for r in osm.read_overpass(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("relation", 1), ("way", 1)]
    assert [[len(r) for r in p] for p in got["way", 1].polygons] == [[4]]
    assert [[len(r) for r in p] for p in got["relation", 1].polygons] == [[5, 4], [4]]
    strict = osm.read_overpass(spark, str(tmp_path), strict_roles=True).where("osm_type = 'relation'").collect()
    assert [[len(r) for r in p] for p in strict[0].polygons] == [[5, 4]]
    kept = osm.crop_buildings(osm.read_overpass(spark, str(tmp_path))).collect()
    assert [(r.osm_id, r.material, r.shape) for r in kept] == [(1, "tar_paper", "flat")]


def test_overpass_text():
    text = osm.green_roof_query(relation=5326784, parts=True)
    assert "area(3605326784)" in text and text.count("way[") == text.count("relation[") == 10
    assert '"building"]["roof:green"~"^(yes|' in osm.green_roof_query(bbox=(1, 2, 3, 4))
    for wrong in ({}, {"relation": 1, "bbox": (1, 2, 3, 4)}, {"bbox": (3, 2, 1, 4)}, {"relation": 1, "values": [" "]}):
        with pytest.raises(ValueError):
            osm.green_roof_query(**wrong)


def gml(*buildings):
    return '<c:CityModel xmlns:c="urn:c" xmlns:b="urn:b" xmlns:gml="http://www.opengis.net/gml">' + "".join(buildings) + "</c:CityModel>"


def building(name, *planes):
    roofs = "".join(f"<b:boundedBy><b:RoofSurface><gml:Polygon>{p}</gml:Polygon></b:RoofSurface></b:boundedBy>" for p in planes)
    return f'<c:cityObjectMember><b:Building gml:id="{name}"><b:roofType>1000</b:roofType>{roofs}</b:Building></c:cityObjectMember>'


def ring(kind, text, attributes=""):
    return f"<gml:{kind}><gml:LinearRing><gml:posList{attributes}>{text}</gml:posList></gml:LinearRing></gml:{kind}>"


def test_citygml(spark, tmp_path):
    flat = ring("exterior", "0 0 5 10 0 5 10 10 5 0 10 5 0 0 5", ' srsDimension="3"') + ring("interior", "1 1 5 3 1 5 3 3 5 1 3 5 1 1 5")
    steep = "<gml:exterior>" + "".join(f"<gml:pos>{p}</gml:pos>" for p in ("0 0 0", "10 0 10", "10 1 10", "0 1 0")) + "</gml:exterior>"
    (tmp_path / "1.gml").write_text(gml(building("A", flat, steep), building("B"), building("C", ring("exterior", "0 0 1 1 2 2"))))
    (tmp_path / "2.gml").write_text(gml(building("A", steep), building("B", flat), building("D", steep)))
    planes = citygml.read_roof_planes(spark, str(tmp_path))
    got = {r.gml_id: r for r in citygml.slope_stats(planes).collect()}
    assert sorted(got) == ["A", "D"]
    a = got["A"]
    assert a.roof_plane_count == 2 and a.citygml_roof_type == "1000"
    assert a.roof_area_2d_m2 == pytest.approx(96 + 10) and a.roof_slope_max_deg == pytest.approx(45) and a.roof_slope_min_deg == pytest.approx(0, abs=1e-6)
    assert a.roof_slope_mean_deg == pytest.approx(450 / 106) and a.roof_area_share_le_15deg == pytest.approx(96 / 106)
    layer = spark.createDataFrame([(" A ", 1), ("B", 2), (None, 3), ("D", 4)], "gml_id string, n int")
    stats = citygml.slope_stats(planes, layer.where("n < 4"))
    rows = {r.n: r.roof_plane_count for r in citygml.enrich(layer, stats).collect()}
    assert rows == {1: 2, 2: None, 3: None, 4: None}
    with pytest.raises(ValueError):
        citygml.enrich(citygml.enrich(layer, stats), stats)
    assert citygml.enrich(citygml.enrich(layer, stats), stats, replace=True).count() == 4


def test_utm(spark):
    """On the central meridian the northing is the scaled length of the meridian's arc, integrated here; off it, distances hold."""
    e2 = 2 / 298.257223563 - (1 / 298.257223563) ** 2
    arc = lambda lat, n=20000: sum(6378137 * (1 - e2) / (1 - e2 * math.sin(math.radians(lat) * (i + 0.5) / n) ** 2) ** 1.5 for i in range(n)) * math.radians(lat) / n
    rows = spark.createDataFrame([(9.0, 48.0), (9.0, -33.0), (10.001, 48.0), (10.0, 48.0), (180.0, 0.0)], "lon double, lat double")
    x, y = scalars.utm("lon", "lat", 32)
    got = rows.select(x.alias("x"), y.alias("y"), scalars.utm_zone("lon").alias("z")).collect()
    assert got[0].x == pytest.approx(500000, abs=1e-6) and got[0].y == pytest.approx(0.9996 * arc(48.0), abs=1e-3)
    assert got[1].y == pytest.approx(1e7 - 0.9996 * arc(33.0), abs=1e-3)
    apart = 6378137 / math.sqrt(1 - e2 * math.sin(math.radians(48)) ** 2) * math.cos(math.radians(48)) * math.radians(0.001)
    assert math.dist(got[2][:2], got[3][:2]) == pytest.approx(apart, rel=6e-4)
    assert [r.z for r in got] == [32, 32, 32, 32, 60]


def test_ring_holds(spark):
    ring_sql = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 2D, 'y', 1D), named_struct('x', 0D, 'y', 4D))"
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0), (-1.0, 0.5)], "px double, py double").withColumn("ring", F.expr(ring_sql))
    assert [r[0] for r in rows.select(scalars.ring_holds(F.col("ring"), F.col("px"), F.col("py"))).collect()] == [True, False, True, False, False]


def test_points_on_edges_are_outside(spark):
    """A point on an edge or a corner, of the exterior or of a hole, is not within, as on the edges of a box."""
    zone = "array(array({}, {}))".format(*("array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ring) + ")" for ring in (((0, 0), (8, 0), (8, 8), (0, 8)), ((2, 2), (4, 2), (4, 4), (2, 4)))))
    zones = spark.range(5, 6).withColumn("polygons", F.expr(zone))
    places = {1: (1, 1), 2: (0, 0), 3: (0, 4), 4: (4, 0), 5: (8, 4), 6: (8, 8), 7: (2, 3), 8: (3, 2), 9: (4, 4), 10: (3, 3), 11: (5, 4), 12: (0, 8)}
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in places.items()], "id long, x double, y double")
    assert {r.id for r in spatial.points_within(points, zones, 3.0).where("zone_id = 5").collect()} == {1, 11}


def test_rings_are_parsed_once(spark):
    """The plan of the slope statistics holds the parsing of an exterior and of an interior once each, however often a ring is used."""
    ring_sql = "struct<text:string,dim:string>"
    planes = spark.createDataFrame([("A", "f", 0, "flat", 0, ("0 0 0 1 0 0 1 1 0", "3"), [])], f"gml_id string, file string, ordinal int, roof_type string, plane int, exterior {ring_sql}, interiors array<{ring_sql}>")
    plan = citygml.slope_stats(planes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_neighbours_are_not_broadcast(spark):
    points = spark.range(20).selectExpr("id", "id * 7D AS x", "id * 3D AS y", "1D AS area")
    for found in (spatial.within(points, 10.0), spatial.near_cells(points, 10.0)[1]):
        assert any("SortMergeJoin" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines())


def test_dedup_links_grow_with_points(spark, monkeypatch):
    """Of 400 points, 300 of them at one place and 100 in a chain, links stay under 3 a point, and the groups are those of all pairs."""
    rows = [(i, 5.0, 5.0, float(i % 7)) for i in range(300)] + [(1000 + i, 100.0 + 2.5 * i, 50.0 - (i % 3), None if i % 2 else 4.0) for i in range(100)] + [(2000, None, 5.0, 1.0), (2001, float("nan"), 5.0, 1.0), (2002, 5.0, 9.5, 3.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, area double")
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda nodes, edges: seen.append(edges.count()) or whole(nodes, edges))
    got = sorted((r.id, r.component) for r in graph.dedup_within(points, 4.5).collect())
    assert got == [(6, 0), (1000, 1000), (2000, 2000), (2001, 2001)]
    assert seen[0] < 3 * len(rows)


def test_pairs_of_points_at_one_place(spark):
    """Points that share places, more than one row of ids holds, give every pair once."""
    rows = [(i, float(i % 5) * 3, -0.0 if i % 2 else 0.0) for i in range(40)] + [(90, None, 0.0), (91, float("nan"), 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    expected = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if abs(i % 5 - j % 5) <= 1)
    assert sorted((r.a, r.b) for r in spatial.within(points, 4.0, most=3).collect()) == expected
