"""Vector, label and world files as DataFrames, and sinks for features. Rings are arrays of struct<x, y>."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

_FEATURE = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_COLLECTION = f"type string, features array<{_FEATURE}>, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _polygons(geometry: str) -> Column:
    """Polygons as arrays of rings, whether one or many; null for other kinds of geometry."""
    one = F.array(F.from_json(f"{geometry}.coordinates", "array<array<array<double>>>"))
    many = F.from_json(f"{geometry}.coordinates", "array<array<array<array<double>>>>")
    found = F.when(F.col(f"{geometry}.type") == "Polygon", one).when(F.col(f"{geometry}.type") == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(found, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, ordinal, properties, polygons) of the polygons in GeoJSON files below path, heights dropped, null geometry left out.

    A file is a FeatureCollection, which one task reads; with `lines`, each line is a feature, files are split and ordinal is null.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines, pathGlobFilter="*.{json,geojson,geojsonl}")
    parsed = rows.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _COLLECTION).alias("j"))
    if lines:
        features = parsed.select("file", F.lit(None).cast("int").alias("ordinal"), F.struct("j.id", "j.properties", "j.geometry").alias("f"))
    else:
        features = parsed.select("file", F.posexplode("j.features").alias("ordinal", "f"))
    out = features.select("file", "ordinal", F.col("f.properties").alias("properties"), _polygons("f.geometry").alias("polygons"))
    return out.where("size(polygons) > 0")


def write_geojson_lines(features: DataFrame, path: str, polygons: str = "polygons", mode: str = "errorifexists") -> None:
    """One GeoJSON feature a line, every task its own file; all columns but the polygons become properties."""
    point = lambda p: F.array(p["x"], p["y"])
    rings = F.transform(F.col(polygons), lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates"))
    rest = F.struct(*(c for c in features.columns if c != polygons))
    row = F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), geometry.alias("geometry"))
    features.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_worldfiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, a, b, c, d, e, f): affine transforms of the .jgw and .wld files below path; .jgw wins for one stem.

    A file that has not six numbers gives nulls.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True, pathGlobFilter="*.{jgw,wld}")
    n = F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x.try_cast("double"))
    at = {name: F.get(n, F.lit(i)) for i, name in enumerate("adbecf")}
    rows = rows.select(F.col("_metadata.file_path").alias("file"), *(v.alias(k) for k, v in at.items()))
    c, f = scalars.affine_of_worldfile("a", "d", "b", "e", "c", "f")
    rows = rows.withColumns({"c": c, "f": f, "stem": F.regexp_replace("file", r"\.[^.]*$", "")})
    best = rows.groupBy("stem").agg(F.min_by(F.struct("file", *"abcdef"), F.when(F.col("file").endswith(".jgw"), 0).otherwise(1)).alias("x"))
    return best.select("x.file", "stem", *(f"x.{k}" for k in "abcdef"))


def read_class_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, class_id): the first token of each label file below path; null where it is no integer."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True, pathGlobFilter="*.txt")
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)
    return rows.select(F.col("_metadata.file_path").alias("file"), stem.alias("stem"), F.split(F.trim("value"), r"\s+")[0].try_cast("int").alias("class_id"))


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of the `names` of one YAML file, a list or numbers with names, in one line or in several; numbers are closed up in order."""
    text = spark.read.text(path, wholetext=True).first().value
    found = re.search(r"^names:[ \t]*(.*(?:\n(?:[ \t]+.*|-.*|[ \t]*))*)", text, re.M)
    if not found:
        raise ValueError(f"{path} has no names")
    body = re.sub(r"(^|\s)#.*", "", found[1]).strip()
    parts = re.split(r"[,\n]", body.strip("[]{}"))
    parts = [re.fullmatch(r"(?:-\s+|(\d+)\s*:\s*)?(.*)", x.strip()) for x in parts if x.strip()]
    rows = [(int(x[1]) if x[1] else i, x[2].strip().strip("'\"")) for i, x in enumerate(parts)]
    return spark.createDataFrame([(i, name) for i, (_, name) in enumerate(sorted(rows, key=lambda x: x[0]))], "class_id int, name string")


def list_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg,jpeg}") -> DataFrame:
    """(file) of the files below path, at any depth, whose contents are not read; Spark leaves out files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"))


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV manifest with a header; all columns are strings unless a schema says otherwise."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=False)


def resolve_images(wanted: DataFrame, listing: DataFrame, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """wanted(path) with image: the path as listed in listing(file), else its name under root, else its stem with an extension, in that order.

    One equality join on the possible paths; a path without an image has null. Extra columns of `wanted` stay.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    under = lambda s, x: F.concat(F.lit(root.rstrip("/") + "/"), s, F.lit("." + x))
    tries = [F.col("path"), F.concat(F.lit(root.rstrip("/") + "/"), name)]
    for case in (stem, F.lower(stem), F.upper(stem)):
        tries += [under(case, x) for x in extensions]
    asked = wanted.select("path").distinct().select("path", F.posexplode(F.array(*tries)).alias("place", "file"))
    found = asked.join(listing.select("file").distinct(), "file").groupBy("path").agg(F.min_by("file", "place").alias("image"))
    return wanted.join(found, "path", "left")


def position_list(text: str, dimension: str | None = None) -> Column:
    """Points struct<x, y, z> of a space-separated list; its dimension is given, else 3 or 2 as the count divides.

    Null for fewer than nine numbers, points of fewer than three, or a word that is no number. The text is parsed once, not once a point.
    """
    numbers = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x.try_cast("double"))

    def points(n: Column) -> Column:
        guess = F.when(F.size(n) % 3 == 0, 3).when(F.size(n) % 2 == 0, 2)
        dim = F.coalesce(F.col(dimension).cast("int"), guess) if dimension else guess
        last = F.floor(F.size(n) / dim).cast("int") - 1
        point = lambda i: F.struct(*(F.get(n, (i * dim + k).cast("int")).alias(x) for k, x in enumerate("xyz")))
        return F.when((F.size(n) >= 9) & (dim >= 3) & ~F.exists(n, lambda x: x.isNull()), F.transform(F.sequence(F.lit(0), last), point))

    return F.get(F.transform(F.array(numbers), points), F.lit(0))
