"""Chips of buildings, patches of mosaics and training sets of images, as tables until the files are written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import geotiff
from . import rasterize

# Extensions of an image, the first that exists is taken.
EXTENSIONS = ("tif", "tiff", "png", "jpg", "jpeg")


def masks(zones: DataFrame, transform: tuple[float, ...], height: int, width: int, grown: int = 2, fewest: int = 200) -> DataFrame:
    """(id, r, c): the cells that each of zones(id, polygons) touches, grown by a square; zones of fewer cells are left out."""
    on = zones.select("id", rasterize.on_grid("polygons", transform).alias("polygons"))
    cells = rasterize.cells(on, height, width, all_touched=True).select("id", "r", "c")
    if grown:
        near = lambda x, end: F.explode(F.sequence(F.greatest(F.col(x) - grown, F.lit(0)), F.least(F.col(x) + grown, F.lit(end - 1))))
        cells = cells.select("id", "c", near("r", height).alias("r")).distinct().select("id", "r", near("c", width).alias("c"))
    cells = cells.distinct()
    return cells.join(cells.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= fewest).select("id"), "id", "left_semi")


def _shade(v: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("lo")) / F.greatest(F.lit(1e-6), F.col("hi") - F.col("lo")))) * 255).cast("int")


def chips(pixels: DataFrame, zones: DataFrame, transform: tuple[float, ...], height: int, width: int, bands: int, grown: int = 2, fewest: int = 200) -> DataFrame:
    """(id, r, c, band, v, outside): the masked pixels(r, c, band, v) of one image for each zone, stretched to 0..255 between percentiles 1 and 99.

    The percentiles are those of the whole frame, 0 outside the mask, over all bands; `outside` is what such a 0 becomes. A missing value
    counts as 0. Zones of fewer cells than `fewest`, and chips without contrast (black ones among them), are left out. The first three bands are given, a single one three times.
    """
    mask = masks(zones, transform, height, width, grown, fewest)
    inside = mask.join(pixels.select("r", "c", "band", F.coalesce("v", F.lit(0.0)).alias("v")), ["r", "c"])
    rest = inside.groupBy("id").agg((F.lit(height * width * bands) - F.count("*")).alias("n")).select("id", F.lit(0.0).alias("v"), "n")
    ends = inside.select("id", "v", F.lit(1).cast("long").alias("n")).union(rest).groupBy("id").agg(F.expr("percentile(v, array(0.01, 0.99), n)").alias("p"))
    ends = ends.select("id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")).where("hi > lo")
    shown = inside.where("band < 3").join(ends, "id").select("id", "r", "c", "band", _shade(F.col("v")).alias("v"), _shade(F.lit(0.0)).alias("outside"))
    return shown if bands > 1 else shown.withColumn("band", F.explode(F.array(*(F.lit(b) for b in range(3)))))


def chip_files(found: DataFrame, stem: str, transform: tuple[float, ...], height: int, width: int, epsg: int | None = None) -> DataFrame:
    """(name, content): a TIFF of the whole frame for each id of chips, named by stem and id; save them by geotiff.save_files.

    One task holds one frame at a time.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((height, width, int(rows["band"].max()) + 1), rows["outside"].iloc[0], np.uint8)
        out[rows["r"], rows["c"], rows["band"]] = rows["v"]
        return pd.DataFrame({"name": [f"{stem}_b{int(rows['id'].iloc[0]):03d}.tif"], "content": [geotiff.encode(out, transform, epsg, None)]})

    return found.groupBy("id").applyInPandas(one, "name string, content binary")


def patch_windows(spark: SparkSession, height: int, width: int, size: int, stride: int, partial: bool = False) -> DataFrame:
    """(patch_id, x, y, w, h, name) of the patches of a mosaic, numbered row by row; with partial, those cut by the right and lower edge too."""
    across, down = (len(range(0, n if partial else n - size + 1, stride)) for n in (width, height))
    rows = spark.range(across * down).withColumnRenamed("id", "patch_id")
    rows = rows.withColumns({"x": F.pmod("patch_id", F.lit(max(1, across))) * stride, "y": F.floor(F.col("patch_id") / max(1, across)) * stride})
    rows = rows.withColumns({"w": F.least(F.lit(size), F.lit(width) - F.col("x")), "h": F.least(F.lit(size), F.lit(height) - F.col("y"))})
    return rows.withColumn("name", F.format_string("patch_%06d_x%d_y%d.tif", "patch_id", "x", "y"))


def patches(pixels: DataFrame, height: int, width: int, size: int, stride: int, partial: bool = False) -> DataFrame:
    """pixels(r, c, ...) once for each patch that holds them, with x and y, the patch's first column and row; no join."""

    def starts(at: str, n: int) -> Column:
        last = (n - 1 if partial else n - size) // stride
        low = F.greatest(F.lit(0), F.floor((F.col(at) - size) / stride).cast("int") + 1)
        high = F.least(F.floor(F.col(at) / stride).cast("int"), F.lit(last))
        return F.explode(F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda i: i * stride)))

    return pixels.withColumn("x", starts("c", width)).withColumn("y", starts("r", height))


def training_files(labels: DataFrame, images: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(file, target) of the image of every label(stem, class_id), to be copied to the folder of its class; labels without class or image are left out.

    Of images(file) with one stem the first of EXTENSIONS wins. names(class_id, name) gives folders; without it the number does, and a
    class that it lacks is left out.
    """
    name = F.regexp_extract("file", r"[^/]*$", 0)
    ext = F.regexp_extract("file", r"\.([^./]*)$", 1)
    listed = images.select("file", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.array_position(F.array(*(F.lit(x) for x in EXTENSIONS)), ext).alias("place")).where("place > 0")
    best = listed.groupBy("stem").agg(F.min_by("file", F.struct("place", "file")).alias("file"))
    known = labels.where("class_id is not null").select("stem", "class_id")
    known = known.join(names.select("class_id", "name"), "class_id") if names is not None else known.withColumn("name", F.col("class_id").cast("string"))
    return known.join(best, "stem").select("file", F.concat_ws("/", "name", name).alias("target"))
