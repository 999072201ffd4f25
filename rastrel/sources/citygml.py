"""Roof planes of buildings in CityGML files, their slope statistics, and the join to a layer of buildings."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from .files import position_list

STATS = ("roof_slope_mean_deg", "roof_slope_min_deg", "roof_slope_max_deg", "roof_plane_count", "roof_area_2d_m2", "roof_area_share_le_15deg", "citygml_roof_type")

_ID = "{http://www.opengis.net/gml}id"
_RING = pa.struct([("text", pa.string()), ("dim", pa.int32())])
_PLANE = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("gml_id", pa.string()), ("roof_type", pa.string()), ("plane", pa.int32()), ("exterior", _RING), ("interiors", pa.list_(_RING))])
_PLANE_SQL = "file string, ordinal long, gml_id string, roof_type string, plane int, exterior struct<text:string,dim:int>, interiors array<struct<text:string,dim:int>>"
_ROWS = 2_000


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _below(node, name: str) -> Iterator:
    return (x for x in node.iter() if _local(x) == name)


def _ring(node) -> dict | None:
    """A ring's numbers as one text, from its position list, else from its single positions of three or more numbers."""
    for found in _below(node, "posList"):
        if found.text and found.text.strip():
            dim = found.get("srsDimension", "")
            return {"text": found.text, "dim": int(dim) if dim.isdigit() and int(dim) > 0 else None}
    points = [words[:3] for x in _below(node, "pos") if len(words := (x.text or "").split()) >= 3]
    return {"text": " ".join(" ".join(p) for p in points), "dim": 3} if points else None


def _planes(file: str, ordinal: int, building) -> Iterator[dict]:
    kind = next((x.text.strip() for x in building if _local(x) == "roofType" and x.text), None)
    head = {"file": file, "ordinal": ordinal, "gml_id": building.get(_ID), "roof_type": kind}
    number = -1
    for surface in _below(building, "RoofSurface"):
        for polygon in _below(surface, "Polygon"):
            outer = next((x for x in polygon if _local(x) == "exterior"), None)
            if outer is not None and (ring := _ring(outer)):
                number += 1
                yield head | {"plane": number, "exterior": ring, "interiors": [r for x in polygon if _local(x) == "interior" and (r := _ring(x))]}
    if number < 0:
        yield head | {"plane": None, "exterior": None, "interiors": []}


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[dict] = []
            ordinal = 0
            for _, node in ElementTree.iterparse(io.BytesIO(content.as_py()), events=("end",)):
                if _local(node) == "Building":
                    rows += _planes(file, ordinal, node)
                    ordinal += 1
                    node.clear()
                    if len(rows) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _PLANE)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PLANE)


def read_roof_planes(spark: SparkSession, path: str, pattern: str = "*.gml") -> DataFrame:
    """(file, ordinal, gml_id, roof_type, plane, exterior, interiors) of every roof plane of every building in files below path.

    A building without one gives a row without plane. A file is parsed as a stream by one task; rings are still text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(_scan, _PLANE_SQL)


def _points(text: str, dim: str) -> Column:
    """Points of a ring without the closing one."""
    opened = lambda ring: F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return F.get(F.transform(F.array(position_list(text, dim)), opened), F.lit(0))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column from a generator of one row, across which the optimizer does not copy the expression to each of its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def slope_stats(planes: DataFrame, ids: DataFrame | None = None, id_field: str = "gml_id", low: float = 15.0) -> DataFrame:
    """gml_id and STATS of buildings with a usable roof plane; only those of ids(id_field), trimmed, if given.

    The first occurrence of an id, by file and place, counts, even if none of its planes is usable. A plane needs a slope and
    an area in the ground plan above 0, which is its exterior's less its interiors', 0 at least.
    """
    planes = planes.where("gml_id is not null")
    if ids is not None:
        wanted = ids.select(F.trim(F.col(id_field).cast("string")).alias("gml_id")).where("gml_id <> ''").distinct()
        planes = planes.join(wanted, "gml_id", "left_semi")
    first = planes.groupBy("gml_id").agg(F.min(F.struct("file", "ordinal")).alias("at")).select("gml_id", "at.file", "at.ordinal")
    planes = planes.join(first, ["gml_id", "file", "ordinal"], "left_semi").where("plane is not null")
    keys = ["gml_id", "file", "ordinal", "plane"]
    outer = planes.select(*keys, "roof_type", "interiors", F.col("exterior.text").alias("t"), F.col("exterior.dim").alias("d"))
    outer = _once(outer, "ring", _points("t", "d")).where("size(ring) >= 3")
    outer = _once(outer, "found", F.struct(scalars.newell_slope("ring").alias("slope"), scalars.shoelace("ring").alias("whole")))
    outer = outer.select(*keys, "roof_type", "found.slope", "found.whole")
    holes = planes.select(*keys, F.explode("interiors").alias("i")).select(*keys, F.col("i.text").alias("t"), F.col("i.dim").alias("d"))
    holes = _once(holes, "ring", _points("t", "d")).where("size(ring) >= 3").groupBy(*keys).agg(F.sum(scalars.shoelace("ring")).alias("gone"))
    usable = outer.join(holes, keys, "left").withColumn("a", F.greatest(F.lit(0.0), F.col("whole") - F.coalesce("gone", F.lit(0.0)))).where("slope is not null and a > 0")
    found = usable.groupBy("gml_id").agg(
        (F.sum(F.col("slope") * F.col("a")) / F.sum("a")).alias(STATS[0]), F.min("slope").alias(STATS[1]), F.max("slope").alias(STATS[2]), F.count("*").alias(STATS[3]),
        F.sum("a").alias(STATS[4]), (F.coalesce(F.sum(F.when(F.col("slope") <= low, F.col("a"))), F.lit(0.0)) / F.sum("a")).alias(STATS[5]), F.min("roof_type").alias(STATS[6]),
    )
    return found


def enrich(buildings: DataFrame, stats: DataFrame, id_field: str = "gml_id", replace: bool = False) -> DataFrame:
    """buildings with the slope statistics of their id, trimmed on both sides; null without one, and for a null id.

    ValueError if a statistic's name is taken, unless `replace`.
    """
    names = [c for c in stats.columns if c != "gml_id"]
    taken = [c for c in names if c in buildings.columns]
    if taken and not replace:
        raise ValueError(f"columns exist already: {taken}")
    right = stats.select(F.trim("gml_id").alias("_id"), *names)
    left = buildings.drop(*taken)
    return left.join(right, F.trim(F.col(id_field).cast("string")) == F.col("_id"), "left").drop("_id")
