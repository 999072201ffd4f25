"""OpenStreetMap answers in Overpass JSON as polygon rows, and the text of the queries that ask for them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.select import GREEN_KEYS
from ..operators.spatial import top_one

# What areas of relations add to their ids, and default tag values of green roofs.
AREA_OF_RELATION = 3_600_000_000
GREEN_MATERIALS = ("grass", "green_roof", "vegetated", "vegetation", "plants", "sedum")
GREEN_VALUES = ("yes", "true", "green", "extensive", "intensive", "vegetated")
# Roof materials and shapes that training crops are taken of.
CROP_MATERIALS = ("concrete", "glass", "metal", "roof_tiles", "tar_paper")
CROP_SHAPES = ("flat", "gabled", "hipped", "pyramidal", "skillion")

_POINTS = "array<struct<lat:double,lon:double>>"
_ANSWER = f"elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:{_POINTS},members:array<struct<type:string,role:string,geometry:{_POINTS}>>>>"


def anchored(values: Iterable[str]) -> str:
    """A pattern that matches any of the values whole; ValueError for none."""
    kept = [re.escape(v.strip()) for v in values if v.strip()]
    if not kept:
        raise ValueError("no values")
    return "^(" + "|".join(kept) + ")$"


def green_roof_query(*, relation: int | None = None, bbox: tuple[float, float, float, float] | None = None, materials: Iterable[str] = GREEN_MATERIALS, values: Iterable[str] = GREEN_VALUES, parts: bool = False, timeout: int = 180) -> str:
    """Overpass text for green roofs in a relation's area or in (south, west, north, east): each tag for ways and relations."""
    if (relation is None) == (bbox is None):
        raise ValueError("one of relation and bbox is required")
    if bbox and not (bbox[0] < bbox[2] and bbox[1] < bbox[3]):
        raise ValueError("bbox must be south, west, north, east")
    where = "(area.searched)" if bbox is None else "({},{},{},{})".format(*bbox)
    tags = [("roof:material", anchored(materials)), *((k, anchored(values)) for k in GREEN_KEYS)]
    kinds = ["building", "building:part"] if parts else ["building"]
    asked = [f'  {element}["{kind}"]["{key}"~"{pattern}",i]{where};' for kind in kinds for key, pattern in tags for element in ("way", "relation")]
    area = [f"area({AREA_OF_RELATION + relation})->.searched;"] if relation is not None else []
    return "\n".join([f"[out:json][timeout:{timeout}];", *area, "(", *asked, ");", "out tags geom;"])


def _closed(points: Column) -> Column:
    """A closed ring of struct<x, y> from known points; null for fewer than three."""
    known = F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    ring = F.transform(known, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    ends = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    return F.when(F.size(ring) >= 3, F.when(ends, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))


def read_overpass(spark: SparkSession, path: str, strict_roles: bool = False) -> DataFrame:
    """(osm_type, osm_id, tags, polygons) of the ways and relations in saved answers below path, the first of each type and id.

    A way is one ring. A relation's outer members are polygons, and an inner one is a hole of those that hold its first
    corner. Members of other roles are outer, unless `strict_roles`. Elements without a ring of three points are left out.
    An answer is read by one task.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True, pathGlobFilter="*.json")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", _ANSWER)["elements"]).alias("place", "e"))
    rows = rows.select("file", "place", F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), "e.geometry", "e.members")
    rows = top_one(rows, ["osm_type", "osm_id"], F.col("file"), F.col("place"))
    rings = lambda test: F.filter(F.transform(F.filter("members", test), lambda m: _closed(m["geometry"])), lambda r: r.isNotNull())
    inner = lambda m: F.coalesce(m["role"] == "inner", F.lit(False))
    outer = (lambda m: m["role"] == "outer") if strict_roles else (lambda m: ~inner(m))
    rows = rows.withColumns({"way": _closed(F.col("geometry")), "outers": rings(outer), "inners": rings(inner)})
    holes = lambda o: F.filter("inners", lambda i: scalars.ring_holds(o, i[0]["x"], i[0]["y"]))
    relation = F.transform("outers", lambda o: F.concat(F.array(o), F.coalesce(holes(o), F.expr("array()").cast("array<array<struct<x:double,y:double>>>"))))
    polygons = F.when((F.col("osm_type") == "way") & F.col("way").isNotNull(), F.array(F.array("way"))).when(F.col("osm_type") == "relation", relation)
    return rows.select("osm_type", "osm_id", "tags", polygons.alias("polygons")).where("size(polygons) > 0")


def crop_buildings(elements: DataFrame) -> DataFrame:
    """elements with material and shape, normalised, where both are among those crops are taken of."""
    named = elements.withColumns({x: scalars.label(F.col("tags").getItem(f"roof:{x}")) for x in ("material", "shape")})
    return named.where(F.col("material").isin(*CROP_MATERIALS) & F.col("shape").isin(*CROP_SHAPES))
