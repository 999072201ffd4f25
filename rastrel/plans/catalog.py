"""Queries over the driver's tables by name, each with DuckDB SQL for its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, materials, model, overlay, raster, rasterize, select, spatial, tables
from ..sources import citygml
from . import scenario
from .views import PIXEL, frame, query, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LST = "CASE WHEN qa & 191 = 0 THEN st * CAST(0.00341802 AS DOUBLE) + CAST(-124.14999999999998 AS DOUBLE) END"
_S = "* CAST(0.0000275 AS DOUBLE) - CAST(0.2 AS DOUBLE)"
INDEXED = f"""scaled AS (SELECT r, c, {LST} AS lst, b2 {_S} AS blue, b4 {_S} AS red, b5 {_S} AS nir, b6 {_S} AS s1, b7 {_S} AS s2 FROM pixels),
    idx AS (SELECT r, c, lst, greatest(least((nir - red) / (nir + red + 1e-6), 1.0), -1.0) AS ndvi,
        greatest(least(0.356 * blue + 0.130 * red + 0.373 * nir + 0.085 * s1 + 0.072 * s2 - 0.0018, 1.0), 0.0) AS albedo,
        greatest(least((s1 - nir) / (s1 + nir + 1e-6), 1.0), -1.0) AS ndbi FROM scaled)"""
TARGETS = {"ndvi": 0.50988, "albedo": 0.14360, "ndbi": -0.15313}


def own(sql: str) -> Callable[[Query], Query]:
    """Registers a DataFrame query under its function's name, with DuckDB SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, with_views(sql)
        return f

    return put


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """df with columns rounded for comparison."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, lst, ndvi, albedo, ndbi)"""
    return raster.indices(raster.surface_temperature(frame(spark, sf_dir, "pixels"))).select("r", "c", "lst", "ndvi", "albedo", "ndbi")


def rows_of(pixels: DataFrame) -> int:
    """Rows of the frame: up to the table's last in one aggregation, and 100 at least."""
    return max(100, last_row(pixels) + 1)


def last_row(pixels: DataFrame) -> int:
    """The table's last row, found in one aggregation; -1 for none."""
    last = pixels.agg(F.max("r")).first()[0]
    return -1 if last is None else last


# raster algebra
@own(f"SELECT r, c, round({LST}, 9) AS lst FROM pixels")
def surface_temperature(spark, sf_dir):
    return rounded(raster.surface_temperature(frame(spark, sf_dir, "pixels")).select("r", "c", "lst"), "lst", digits=9)


@own("SELECT count(*) FILTER (WHERE qa & 191 = 0) AS clear, count(*) FILTER (WHERE qa & 63 = 0) AS clear_with_water, count(*) AS n FROM pixels")
def quality_bits(spark, sf_dir):
    return frame(spark, sf_dir, "pixels").agg(F.count_if(raster.clear()).alias("clear"), F.count_if(raster.clear(keep_water=True)).alias("clear_with_water"), F.count("*").alias("n"))


@own(f"WITH {INDEXED} SELECT r, c, round(ndvi, 6) AS ndvi, round(albedo, 6) AS albedo, round(ndbi, 6) AS ndbi FROM idx")
def spectral_indices(spark, sf_dir):
    return rounded(indexed(spark, sf_dir).drop("lst"), "ndvi", "albedo", "ndbi")


@own(f"WITH {INDEXED} SELECT CAST(floor(r / 4.0) AS INT) AS r, CAST(floor(c / 4.0) AS INT) AS c, round(avg(lst), 3) AS mean FROM idx GROUP BY 1, 2")
def block_mean(spark, sf_dir):
    return rounded(raster.block_mean(indexed(spark, sf_dir), "lst", 4), "mean", digits=3)


@own(f"WITH {INDEXED} SELECT round(coalesce(median(CASE WHEN ndvi > 0.3 AND lst IS NOT NULL THEN ndvi END), 0.5), 6) AS target FROM idx")
def target_ndvi_fallback(spark, sf_dir):
    return rounded(model.green_target(indexed(spark, sf_dir)), "target")


@own("WITH q AS (SELECT quantile_cont(b5, 0.01) AS lo, quantile_cont(b5, 0.99) AS hi FROM pixels) SELECT r, c, CAST(floor(least(greatest((b5 - lo) / greatest(1e-6, hi - lo), 0.0), 1.0) * 255) AS INT) AS v FROM pixels CROSS JOIN q")
def percentile_stretch(spark, sf_dir):
    return raster.stretched(frame(spark, sf_dir, "pixels"), "b5", 0.01, 0.99).select("r", "c", "v")


@own(f"WITH {INDEXED} SELECT round(avg(a.lst - b.lst), 6) AS mean_cooling, count(a.lst - b.lst) AS n FROM idx a JOIN idx b ON a.r = b.r AND a.c = b.c + 1")
def raster_difference(spark, sf_dir):
    lst = indexed(spark, sf_dir).select("r", "c", "lst")
    found = raster.difference(lst, lst.withColumn("c", F.col("c") + 1), "lst")
    return rounded(found.agg(F.avg("difference").alias("mean_cooling"), F.count("difference").alias("n")), "mean_cooling")


@own("SELECT r, c, st FROM pixels WHERE r BETWEEN 5 AND 9 AND c BETWEEN 10 AND 30")
def window_read(spark, sf_dir):
    return raster.window(frame(spark, sf_dir, "pixels").select("r", "c", "st"), 5, 9, 10, 30)


@own("SELECT r, c, st FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY f) AS n FROM (SELECT r, c, st, 1 AS f FROM pixels WHERE c < 60 UNION ALL SELECT r, c, st + 1 AS st, 2 AS f FROM pixels WHERE c >= 40) u) t WHERE n = 1")
def mosaic_first_wins(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels").select("r", "c", "st")
    return raster.mosaic(pixels.where("c < 60"), pixels.where("c >= 40").withColumn("st", F.col("st") + 1))


@own("SELECT a.r - 1 AS r, a.c - 1 AS c, a.b4 FROM pixels a WHERE a.r >= 1 AND a.c >= 1")
def aligned_shift(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels")
    moved = raster.resample(pixels, ["b4"], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 0.0, 1.0, 1.0), last_row(pixels), 99)
    return moved.withColumn("b4", F.round("b4").cast("int"))


@own("SELECT a.r, a.c, (a.b5 + b.b5 + c.b5 + d.b5) / CAST(4 AS DOUBLE) AS v FROM pixels a JOIN pixels b ON b.r = a.r AND b.c = a.c + 1 JOIN pixels c ON c.r = a.r + 1 AND c.c = a.c JOIN pixels d ON d.r = a.r + 1 AND d.c = a.c + 1")
def bilinear_resample(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels")
    return raster.resample(pixels, ["b5"], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.5, 0.0, 1.0, 0.5), last_row(pixels), 99).withColumnRenamed("b5", "v")




@own("SELECT CAST(floor(r / 10.0) AS INT) AS ty, CAST(floor(c / 10.0) AS INT) AS tx, count(*) AS n, max(st) AS most FROM pixels GROUP BY 1, 2")
def tumbling_tiles(spark, sf_dir):
    return raster.tumbling(frame(spark, sf_dir, "pixels"), 10).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.max("st").alias("most"))


@own("SELECT round(covar_samp(c, r), 6) AS cxy, round(var_samp(c), 6) AS cxx, round(var_samp(r), 6) AS cyy FROM pixels WHERE qa = 0")
def mask_covariance(spark, sf_dir):
    return rounded(raster.covariance(frame(spark, sf_dir, "pixels").where("qa = 0")), "cxy", "cxx", "cyy")


@own("SELECT r, c, CAST(round(0.114 * (b2 % 256) + 0.587 * (b4 % 256) + 0.299 * (b5 % 256)) > 5 AS INT) AS m FROM pixels")
def grey_mask(spark, sf_dir):
    return frame(spark, sf_dir, "pixels").select("r", "c", raster.grey_mask(F.col("b2") % 256, F.col("b4") % 256, F.col("b5") % 256).alias("m"))




@own("SELECT DISTINCT r + dr AS r, c + dc AS c FROM (SELECT r, c FROM pixels WHERE qa = 8) p CROSS JOIN (SELECT unnest(range(-2, 3)) AS dr) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS dc) b WHERE r + dr BETWEEN 0 AND (SELECT greatest(99, max(r)) FROM pixels) AND c + dc BETWEEN 0 AND 99")
def dilated_mask(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels")
    out = raster.dilate(pixels.where("qa = 8"), 2, rows_of(pixels), 100)
    return out.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@own("WITH s AS (SELECT unnest([0, 96, 192, 288, 308]) AS y), t AS (SELECT unnest([0, 96, 128]) AS x) SELECT y, x FROM s CROSS JOIN t")
def sliding_windows(spark, sf_dir):
    return raster.windows(spark, 500, 320)


# scalars and selections
@own("SELECT DISTINCT p_type AS raw, regexp_replace(lower(trim(p_type)), '[- ]', '_', 'g') AS label, trim(regexp_replace(p_type, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS slug FROM part")
def labels_and_slugs(spark, sf_dir):
    return frame(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("raw"), scalars.label("p_type").alias("label"), scalars.slug("p_type").alias("slug"))


@own("SELECT id FROM buildings WHERE material IN ('building', 'machinery') AND slope <= 20")
def select_buildings(spark, sf_dir):
    rows = frame(spark, sf_dir, "buildings").withColumn("listed", F.concat(F.lit("['"), F.upper("seg"), F.lit("', 'x']")))
    return select.subset(rows, material=("listed", ["Building", "machinery "]), slope=("slope", 20.0)).select("id")


@own("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 1")
def green_roof_tags(spark, sf_dir):
    tags = F.create_map(F.lit("roof:material"), F.when(F.col("p_partkey") % 3 == 0, "Sedum").otherwise("tiles"), F.lit("green_roof"), F.when(F.col("p_partkey") % 5 == 1, "YES").otherwise("no"))
    return frame(spark, sf_dir, "part").withColumn("tags", tags).where(select.is_green()).select(F.col("p_partkey").alias("id"))


@own("SELECT id, area_m2 FROM buildings WHERE area_m2 >= 2000")
def minimum_area(spark, sf_dir):
    return tables.minimum_area(frame(spark, sf_dir, "buildings"), 2000).select("id", "area_m2")


@own(f"WITH {INDEXED} SELECT r, c FROM idx WHERE lst IS NOT NULL AND ndvi IS NOT NULL AND albedo IS NOT NULL AND ndbi IS NOT NULL")
def finite_rows(spark, sf_dir):
    return model.complete(indexed(spark, sf_dir)).select("r", "c")


@own("SELECT id, concat('patch_', lpad(CAST(id AS VARCHAR(20)), 6, '0'), '_x', CAST(CAST(x0 AS INT) AS VARCHAR(20))) AS name FROM buildings")
def formatted_ids(spark, sf_dir):
    return frame(spark, sf_dir, "buildings").select("id", scalars.patch_name("id", "x0").alias("name"))


@own("SELECT id, round((x1 - x0) * CAST(1.1 AS DOUBLE) / 512, 6) AS pixel_size, round(x0 - (x1 - x0) * CAST(0.05 AS DOUBLE) - (x1 - x0) * CAST(1.1 AS DOUBLE) / 1024, 6) AS c, round(y1 + (y1 - y0) * CAST(0.05 AS DOUBLE) + (y1 - y0) * CAST(1.1 AS DOUBLE) / 1024, 6) AS f FROM buildings")
def world_file(spark, sf_dir):
    boxes = frame(spark, sf_dir, "buildings")
    a, d, b, e, c, f = scalars.crop_world_file(F.expr("(x0 + x1) / 2"), F.expr("(y0 + y1) / 2"), F.expr("x1 - x0"))
    rows = boxes.select("id", a.alias("a"), d.alias("d"), b.alias("b"), (-e).alias("e"), c.alias("c"), f.alias("f"))
    x, y = scalars.affine_of_worldfile("a", "d", "b", "e", "c", "f")
    return rows.select("id", F.round("a", 6).alias("pixel_size"), F.round(x, 6).alias("c"), F.round(F.col("f") + (F.col("f") - y), 6).alias("f"))




@own("SELECT id, round(radians(x0 / 100) * 6378137, 4) AS x, round(ln(tan(CAST(0.7853981633974483 AS DOUBLE) + radians(y0 / 100) / 2)) * 6378137, 4) AS y FROM buildings")
def project_3857(spark, sf_dir):
    rows = frame(spark, sf_dir, "buildings").select("id", (F.col("x0") / 100).alias("lon"), (F.col("y0") / 100).alias("lat"))
    x, y = scalars.mercator("lon", "lat")
    return rows.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@own("SELECT id, round(area_m2, 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(degrees(atan(slope / 45)), 6) AS slope FROM buildings")
def ring_geometry(spark, sf_dir):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) * F.col("slope") / 45).alias("z"))
    rows = frame(spark, sf_dir, "buildings").withColumn("ring", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")))
    out = rows.select("id", scalars.shoelace("ring").alias("area"), scalars.centroid("ring", "x").alias("cx"), scalars.centroid("ring", "y").alias("cy"), scalars.newell_slope("ring").alias("slope"))
    return rounded(out, "area", "cx", "cy", "slope")


# joins
TOUCHED = f"p.c >= floor(b.x0 / {PIXEL}) AND p.c <= ceil(b.x1 / {PIXEL}) - 1 AND p.r >= floor(b.y0 / {PIXEL}) AND p.r <= ceil(b.y1 / {PIXEL}) - 1"
SHARED = f"(least(b.x1, (p.c + 1) * {PIXEL}) - greatest(b.x0, p.c * {PIXEL})) * (least(b.y1, (p.r + 1) * {PIXEL}) - greatest(b.y0, p.r * {PIXEL}))"
BOXES = "least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"
AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def zoned(spark, sf_dir, all_touched=True):
    pixels = raster.surface_temperature(frame(spark, sf_dir, "pixels")).select("r", "c", "lst")
    return spatial.zonal(pixels, frame(spark, sf_dir, "buildings").select("id", *spatial.BOX), PIXEL, all_touched)


@own(f"SELECT b.id, round(avg({LST}), 3) AS mean, count({LST}) AS n FROM buildings b JOIN pixels p ON {TOUCHED} GROUP BY b.id")
def zonal_mean(spark, sf_dir):
    return rounded(zoned(spark, sf_dir).groupBy("id").agg(F.avg("lst").alias("mean"), F.count("lst").alias("n")), "mean", digits=3)


@own(f"SELECT b.id, round(avg({LST}), 3) AS mean FROM buildings b JOIN pixels p ON (p.c + 0.5) * {PIXEL} >= b.x0 AND (p.c + 0.5) * {PIXEL} < b.x1 AND (p.r + 0.5) * {PIXEL} >= b.y0 AND (p.r + 0.5) * {PIXEL} < b.y1 GROUP BY b.id")
def zonal_mean_of_centres(spark, sf_dir):
    return rounded(zoned(spark, sf_dir, all_touched=False).groupBy("id").agg(F.avg("lst").alias("mean")), "mean", digits=3)


@own(f"SELECT id, round(sum(v * w) / nullif(sum(w), 0), 3) AS mean FROM (SELECT b.id, {LST} AS v, CASE WHEN qa & 191 = 0 THEN {SHARED} END AS w FROM buildings b JOIN pixels p ON {TOUCHED}) x GROUP BY id")
def zonal_weighted_mean(spark, sf_dir):
    w = F.when(F.col("lst").isNotNull(), F.col("area"))
    return rounded(zoned(spark, sf_dir).groupBy("id").agg(F.try_divide(F.sum(F.col("lst") * w), F.sum(w)).alias("mean")), "mean", digits=3)


@own(f"SELECT id, match_id, area FROM (SELECT a.id, b.id AS match_id, CASE WHEN b.id IS NOT NULL THEN {AREA} END AS area, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN b.id IS NOT NULL THEN {AREA} END DESC NULLS LAST, b.id) AS n FROM buildings a LEFT JOIN roofs b ON {BOXES}) t WHERE n = 1")
def biggest_overlap(spark, sf_dir):
    left = frame(spark, sf_dir, "buildings").select("id", *spatial.BOX)
    return spatial.biggest_overlap(left, frame(spark, sf_dir, "roofs"), 100.0).select("id", "match_id", "area")


@own(f"WITH p AS (SELECT a.id, b.id AS match_id, {AREA} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {AREA}) AS iou FROM buildings a JOIN roofs b ON {BOXES}) SELECT id, match_id, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, match_id) AS n FROM p WHERE iou >= 0.1) t WHERE n = 1")
def best_iou(spark, sf_dir):
    left = frame(spark, sf_dir, "buildings").select("id", *spatial.BOX)
    return rounded(spatial.best_iou(left, frame(spark, sf_dir, "roofs"), 100.0), "iou")


@own("SELECT b.id, min(r.id) AS box_id FROM buildings b LEFT JOIN roofs r ON b.x0 > r.x0 AND b.x0 < r.x1 AND b.y0 > r.y0 AND b.y0 < r.y1 GROUP BY b.id")
def point_in_box(spark, sf_dir):
    points = frame(spark, sf_dir, "buildings").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return spatial.points_in(points, frame(spark, sf_dir, "roofs"), 100.0).select("id", "box_id")


@own("SELECT a.id AS a, b.id AS b FROM buildings a JOIN buildings b ON a.id < b.id AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 22500")
def distance_pairs(spark, sf_dir):
    return spatial.within(frame(spark, sf_dir, "buildings").select("id", F.col("x0").alias("x"), F.col("y0").alias("y")), 150.0)


@own("SELECT b.id, o.n_planes, o.total FROM buildings b LEFT JOIN (SELECT o_custkey, count(*) AS n_planes, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON b.id = o.o_custkey")
def slope_join(spark, sf_dir):
    stats = frame(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("gml_id")).agg(F.count("*").alias("n_planes"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return citygml.enrich(frame(spark, sf_dir, "buildings").select("id"), stats, "id")


@own("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def target_ids_semi(spark, sf_dir):
    found = tables.with_ids(frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return found.select(F.col("c_custkey").alias("id"))


@own("SELECT count(*) AS missing FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def unfound_ids(spark, sf_dir):
    return tables.unfound(frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "orders"), "c_custkey", "o_custkey")



@own("""SELECT b.id, coalesce(m.s_suppkey, f.match_id) AS match_id FROM buildings b LEFT JOIN supplier m ON m.s_suppkey = b.id
    LEFT JOIN (SELECT b.id, min(r.id) AS match_id FROM buildings b JOIN roofs r ON b.x0 > r.x0 AND b.x0 < r.x1 AND b.y0 > r.y0 AND b.y0 < r.y1 GROUP BY b.id) f ON f.id = b.id""")
def id_join_with_fallback(spark, sf_dir):
    points = frame(spark, sf_dir, "buildings").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    zones = frame(spark, sf_dir, "roofs").select("id", polygon(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")).alias("polygons"))
    suppliers = frame(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("match_id"))
    held = spatial.points_within(points, zones, 100.0).groupBy("id").agg(F.min("zone_id").alias("zone_id"))
    return tables.first_match(points, "id", (suppliers, "match_id"), (held, "zone_id")).select("id", "match_id")




@own("SELECT a.r, a.c, a.b4, b.b5 FROM (SELECT r, c, b4 FROM pixels) a JOIN (SELECT r, c, b5 FROM pixels) b ON a.r = b.r AND a.c = b.c")
def band_registration(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels")
    return raster.register({b: pixels.select("r", "c", F.col(b).alias("v")) for b in ("b4", "b5")})



# aggregates and windows


@own("SELECT round(avg(slope), 6) AS mean, round(sum(slope * area_m2) / sum(area_m2), 6) AS weighted, round(max(slope), 6) AS most, round(avg(CASE WHEN material = 'building' THEN slope END), 6) AS selected_mean FROM buildings")
def building_stats(spark, sf_dir):
    found = tables.weighted_summary(frame(spark, sf_dir, "buildings"), "slope", "area_m2", F.col("material") == "building")
    return rounded(found, "mean", "weighted", "most", "selected_mean")


@own(f"""WITH {INDEXED}, u AS (SELECT 'ndvi' AS parameter, ndvi AS v, b AS w FROM x UNION ALL SELECT 'albedo', albedo, b FROM x UNION ALL SELECT 'ndbi', ndbi, b FROM x)
    SELECT parameter, count(v) AS valid_roofs, round(avg(v), 6) AS unweighted_mean, round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS area_weighted_mean FROM u GROUP BY parameter""".replace(", u AS", ", x AS (SELECT ndvi, albedo, ndbi, 1.0 + r % 4 AS b FROM idx WHERE lst IS NOT NULL), u AS"))
def parameter_summary(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("lst is not null").select(*(F.col(x).alias(f"mean_{x}") for x in scenario.PARAMETERS), (F.col("r") % 4 + 1.0).alias("roof_area_m2"))
    return rounded(scenario.summary(rows), "unweighted_mean", "area_weighted_mean")


@own("SELECT material, count(*) AS n, round(avg(slope), 6) AS mean, round(stddev_samp(slope), 6) AS std, round(min(slope), 6) AS least, round(max(slope), 6) AS most FROM buildings WHERE material IS NOT NULL GROUP BY material")
def roof_type_summary(spark, sf_dir):
    return rounded(tables.group_summary(tables.known(frame(spark, sf_dir, "buildings"), "material"), "material", "slope"), "mean", "std", "least", "most")


@own("SELECT material, round(avg(slope), 6) AS mean FROM buildings WHERE material IN ('building', 'household') GROUP BY material")
def roof_type_means(spark, sf_dir):
    return rounded(tables.group_means(frame(spark, sf_dir, "buildings"), "material", "slope", ["building", "household"]), "mean")


@own("SELECT o_custkey AS id, round(sum(s * a) / sum(a), 6) AS mean_slope, round(min(s), 6) AS least, round(max(s), 6) AS most, count(*) AS planes, round(sum(CASE WHEN s <= 15 THEN a ELSE 0 END) / sum(a), 6) AS low_share FROM (SELECT o_custkey, o_totalprice - 60 * floor(o_totalprice / 60) AS s, 1 + o_orderkey % 9 AS a FROM orders) p GROUP BY o_custkey")
def slope_stats(spark, sf_dir):
    # a plane of the wanted slope: a strip one unit deep and as long as its area, raised along its length
    planes = frame(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("gml_id"), F.col("o_orderkey").alias("plane"), F.expr("o_totalprice - 60 * floor(o_totalprice / 60)").alias("s"), F.expr("1 + o_orderkey % 9").alias("a"))
    text = F.concat_ws(" ", F.lit("0 0 0"), "a", F.lit("0"), F.expr("a * tan(radians(s))"), "a", F.lit("1"), F.expr("a * tan(radians(s))"), F.lit("0 1 0 0 0 0"))
    ring = F.struct(text.alias("text"), F.lit("3").alias("dim"))
    planes = planes.select("gml_id", F.lit("f").alias("file"), F.lit(0).alias("ordinal"), F.lit("flat").alias("roof_type"), "plane", ring.alias("exterior"), F.array().cast("array<struct<text:string,dim:string>>").alias("interiors"))
    found = citygml.slope_stats(planes, low=15.000001)
    mean, least, most, count, _, low, _ = citygml.STATS
    return found.select(F.col("gml_id").cast("long").alias("id"), *(F.round(c, 6).alias(n) for c, n in ((mean, "mean_slope"), (least, "least"), (most, "most"))), F.col(count).alias("planes"), F.round(low, 6).alias("low_share"))


@own("""WITH f AS (SELECT chip, k, px / CAST(sum(px) OVER (PARTITION BY chip) AS DOUBLE) AS frac FROM class_px), m AS (SELECT *, max(frac) OVER (PARTITION BY chip) AS top, row_number() OVER (PARTITION BY chip ORDER BY frac DESC, k) AS place FROM f)
    SELECT chip, k, round(frac, 6) AS frac, row_number() OVER (PARTITION BY chip ORDER BY frac DESC, k) AS rank FROM m WHERE place = 1 OR (frac >= CASE k WHEN 1 THEN 0.09 WHEN 2 THEN 0.15 WHEN 3 THEN 0.03 WHEN 4 THEN 0.03 ELSE 0.02 END AND frac >= 0.2 * top)""")
def material_coverage(spark, sf_dir):
    found = materials.ranked(materials.covered(frame(spark, sf_dir, "class_px"), {1: 0.09, 2: 0.15, 3: 0.03, 4: 0.03}))
    return rounded(found.select("chip", "k", "frac", "rank"), "frac")


@own("SELECT chip, k AS dominant, n FROM (SELECT chip, k, count(*) OVER (PARTITION BY chip) AS n, row_number() OVER (PARTITION BY chip ORDER BY px DESC, k) AS place FROM class_px) t WHERE place = 1")
def dominant_material(spark, sf_dir):
    best = materials.covered(frame(spark, sf_dir, "class_px"), {}).where("top").select("chip", F.col("k").alias("dominant"))
    counts = frame(spark, sf_dir, "class_px").groupBy("chip").agg(F.count("*").alias("n"))
    return best.join(counts, "chip")


@own("SELECT k, count(*) AS n FROM (SELECT chip, k, row_number() OVER (PARTITION BY chip ORDER BY px DESC, k) AS place FROM class_px) t WHERE place = 1 GROUP BY k")
def material_histogram(spark, sf_dir):
    return materials.histogram(materials.covered(frame(spark, sf_dir, "class_px"), {}).where("top"), "k")


@own("SELECT cust, chip, px FROM (SELECT o.o_custkey AS cust, c.chip, c.px, row_number() OVER (PARTITION BY o.o_custkey ORDER BY c.px DESC, c.chip) AS n FROM (SELECT chip, CAST(sum(px) AS BIGINT) AS px FROM class_px GROUP BY chip) c JOIN orders o ON o.o_orderkey = c.chip) t WHERE n = 1")
def best_chip(spark, sf_dir):
    chips = frame(spark, sf_dir, "class_px").groupBy("chip").agg(F.sum("px").alias("px"))
    orders = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chip"), F.col("o_custkey").alias("cust"))
    return materials.best_chip(chips.join(orders, "chip"), "cust").select("cust", "chip", "px")


@own("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) t WHERE n = 1")
def dedup_by_key(spark, sf_dir):
    return tables.first_of(frame(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@own("SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) t WHERE n > 1")
def duplicate_finder(spark, sf_dir):
    return tables.duplicates(frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@own("SELECT count(*) AS n, round(-avg(d), 6) AS mean_cooling, round(-sum(d * area_m2) / sum(area_m2), 6) AS weighted_cooling, round(max(-d), 6) AS most FROM (SELECT area_m2, slope / 45 - 0.5 AS d FROM buildings) b WHERE d < -0.01")
def changed_roofs(spark, sf_dir):
    rows = tables.changed(frame(spark, sf_dir, "buildings").withColumn("d", F.expr("slope / 45 - 0.5")), "d")
    return rounded(tables.change_report(rows, "d", "area_m2").drop("least"), "mean_cooling", "weighted_cooling", "most")


@own("SELECT min(x0) - 100 AS x0, min(y0) - 100 AS y0, max(x1) + 100 AS x1, max(y1) + 100 AS y1 FROM buildings")
def layer_extent(spark, sf_dir):
    return tables.extent(frame(spark, sf_dir, "buildings"), 100)


@own("SELECT id, round(slope - avg_slope, 6) AS anomaly FROM buildings CROSS JOIN (SELECT avg(slope) AS avg_slope FROM buildings) a")
def global_anomaly(spark, sf_dir):
    return rounded(tables.anomalies(frame(spark, sf_dir, "buildings"), "slope").select("id", "anomaly"), "anomaly")


@own("SELECT count(*) AS total, count(CASE WHEN material = 'building' THEN 1 END) AS selected, count(CASE WHEN slope > 40 THEN 1 END) AS steep FROM buildings")
def counters(spark, sf_dir):
    return tables.counters(frame(spark, sf_dir, "buildings"), selected=F.col("material") == "building", steep=F.col("slope") > 40)


@own("SELECT id, 'building' AS kind, material FROM buildings UNION ALL SELECT id, 'roof' AS kind, CAST(NULL AS VARCHAR) AS material FROM roofs")
def unioned_layers(spark, sf_dir):
    return tables.concatenated((frame(spark, sf_dir, "buildings").select("id", "material"), "building"), (frame(spark, sf_dir, "roofs").select("id"), "roof"))


@own("SELECT id, greatest(x0, CAST(500 AS DOUBLE)) AS x0, greatest(y0, CAST(500 AS DOUBLE)) AS y0, least(x1, CAST(2000 AS DOUBLE)) AS x1, least(y1, CAST(2000 AS DOUBLE)) AS y1 FROM buildings WHERE x1 > 500 AND x0 < 2000 AND y1 > 500 AND y0 < 2000")
def clipped_boxes(spark, sf_dir):
    return tables.clipped(frame(spark, sf_dir, "buildings").select("id", *spatial.BOX), 500, 500, 2000, 2000)




# sampling, regression and the scenario
_MIXED = "(CAST(r AS BIGINT) * 73856093 + CAST(c AS BIGINT) * 19349663 + 42) % 2147483647"
HASH = f"(({_MIXED}) * ({_MIXED}) + r * 31 + c) % 2147483647"


@own(f"SELECT r, c FROM (SELECT r, c, row_number() OVER (PARTITION BY floor(r / 3.0), floor(c / 3.0) ORDER BY {HASH}, r, c) AS n FROM pixels WHERE qa & 191 = 0) t WHERE n = 1")
def spatial_thinning(spark, sf_dir):
    return model.thin(frame(spark, sf_dir, "pixels").where(raster.clear()), 3, 42).select("r", "c")


@own(f"SELECT r, c FROM pixels WHERE qa & 191 = 0 ORDER BY {HASH}, r, c LIMIT (SELECT greatest(1000, CAST(floor(0.2 * count(*)) AS BIGINT)) FROM pixels WHERE qa & 191 = 0)")
def random_sample(spark, sf_dir):
    return model.sample(frame(spark, sf_dir, "pixels").where(raster.clear()), 0.2, 42).select("r", "c")


@own(f"SELECT r, c, CASE WHEN row_number() OVER (ORDER BY {HASH}, r, c) <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM (SELECT r, c FROM pixels WHERE qa & 191 = 0) p CROSS JOIN (SELECT count(*) AS n FROM pixels WHERE qa & 191 = 0) t")
def train_test_split(spark, sf_dir):
    return model.split(frame(spark, sf_dir, "pixels").where(raster.clear()).select("r", "c"))


@own("WITH k AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), m AS (SELECT max(n) AS most FROM k), p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS pos FROM labels) SELECT p.quality, p.doc_id, 1 + CAST(floor((m.most - 1 - p.pos) / CAST(k.n AS DOUBLE)) AS BIGINT) AS copies FROM p JOIN k ON k.quality = p.quality CROSS JOIN m")
def oversampled_classes(spark, sf_dir):
    return tables.oversampled(frame(spark, sf_dir, "labels").select("quality", "doc_id"), "quality", "doc_id")



FRACTION = f"SELECT p.r, p.c, least(1.0, sum({SHARED}) / {PIXEL * PIXEL}) AS f FROM buildings b JOIN pixels p ON {TOUCHED} WHERE b.material = 'building' GROUP BY p.r, p.c"


def roof_fractions(spark, sf_dir):
    """(r, c, fraction) of pixels that selected buildings cover, at most 1."""
    chosen = select.subset(frame(spark, sf_dir, "buildings"), material=("material", ["building"]))
    zones = spatial.zonal(frame(spark, sf_dir, "pixels").select("r", "c"), chosen.select("id", *spatial.BOX), PIXEL)
    return zones.groupBy("r", "c").agg(F.least(F.lit(1.0), F.sum("area") / (PIXEL * PIXEL)).alias("fraction"))


@own(f"SELECT r, c, round(f, 6) AS fraction FROM ({FRACTION}) x")
def roof_fraction(spark, sf_dir):
    return rounded(roof_fractions(spark, sf_dir), "fraction")


NORMAL = f"""WITH {INDEXED}, d AS (SELECT * FROM idx WHERE lst IS NOT NULL), m AS (SELECT avg(ndvi) AS a, avg(albedo) AS b, avg(ndbi) AS g, avg(lst) AS l FROM d),
    z AS (SELECT ndvi - a AS x, albedo - b AS y, ndbi - g AS w, lst - l AS t FROM d CROSS JOIN m),
    s AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(x*w) AS xw, sum(y*y) AS yy, sum(y*w) AS yw, sum(w*w) AS ww, sum(x*t) AS xt, sum(y*t) AS yt, sum(w*t) AS wt FROM z),
    e AS (SELECT *, xx*(yy*ww-yw*yw) - xy*(xy*ww-yw*xw) + xw*(xy*yw-yy*xw) AS det FROM s),
    k AS (SELECT (xt*(yy*ww-yw*yw) - xy*(yt*ww-yw*wt) + xw*(yt*yw-yy*wt))/det AS ka, (xx*(yt*ww-yw*wt) - xt*(xy*ww-yw*xw) + xw*(xy*wt-yt*xw))/det AS kb, (xx*(yy*wt-yt*yw) - xy*(xy*wt-yt*xw) + xt*(xy*yw-yy*xw))/det AS kg FROM e)"""


@own(f"{NORMAL} SELECT round(ka, 2) AS ndvi, round(kb, 2) AS albedo, round(kg, 2) AS ndbi FROM k")
def linear_model(spark, sf_dir):
    fitted = model.fit_linear(model.complete(indexed(spark, sf_dir)))
    return spark.createDataFrame([tuple(round(fitted[x], 2) for x in model.INPUTS)], "ndvi double, albedo double, ndbi double")


def scenario_pixels(spark, sf_dir):
    """(r, c, lst, fraction, delta, scenario) of the whole scene."""
    pixels = indexed(spark, sf_dir)
    return model.scenario(pixels, roof_fractions(spark, sf_dir), TARGETS, model.fit_linear(model.complete(pixels)))


@own(f"{NORMAL}, fr AS ({FRACTION}) SELECT i.r, i.c, round(CASE WHEN lst IS NOT NULL THEN CASE WHEN f > 0 THEN f * (ka * ({TARGETS['ndvi']} - ndvi) + kb * ({TARGETS['albedo']} - albedo) + kg * ({TARGETS['ndbi']} - ndbi)) ELSE 0 END END, 3) AS delta FROM idx i CROSS JOIN k LEFT JOIN fr ON fr.r = i.r AND fr.c = i.c")
def scenario_delta(spark, sf_dir):
    return rounded(scenario_pixels(spark, sf_dir).select("r", "c", "delta"), "delta", digits=3)


@own(f"{NORMAL}, fr AS ({FRACTION}), dd AS (SELECT i.r, i.c, lst, CASE WHEN lst IS NOT NULL THEN CASE WHEN f > 0 THEN f * (ka * ({TARGETS['ndvi']} - ndvi) + kb * ({TARGETS['albedo']} - albedo) + kg * ({TARGETS['ndbi']} - ndbi)) ELSE 0 END END AS delta FROM idx i CROSS JOIN k LEFT JOIN fr ON fr.r = i.r AND fr.c = i.c) SELECT b.id, round(avg(p.lst), 3) AS lst_baseline_mean, round(avg(p.delta), 3) AS delta_mean, b.material = 'building' AS selected_for_greening FROM buildings b JOIN dd p ON {TOUCHED} GROUP BY b.id, b.material")
def scenario_buildings(spark, sf_dir):
    zones = frame(spark, sf_dir, "buildings").select("id", *spatial.BOX, "material")
    rows = spatial.zonal(scenario_pixels(spark, sf_dir).select("r", "c", "lst", "delta"), zones, PIXEL)
    out = rows.groupBy("id", "material").agg(F.avg("lst").alias("lst_baseline_mean"), F.avg("delta").alias("delta_mean"))
    return rounded(out.withColumn("selected_for_greening", F.col("material") == "building").drop("material"), "lst_baseline_mean", "delta_mean", digits=3)


# components, tiles and probabilities
NEAR = "(a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 1600"


@own(f"""WITH RECURSIVE links AS (SELECT a.id AS a, b.id AS b FROM buildings a JOIN buildings b ON {NEAR}), reach AS (SELECT id AS a, id AS b FROM buildings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    root AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
    SELECT id, component FROM (SELECT b.id, component, row_number() OVER (PARTITION BY component ORDER BY area_m2 DESC, b.id) AS n FROM buildings b JOIN root ON root.id = b.id) t WHERE n = 1""")
def dedup_within(spark, sf_dir):
    points = frame(spark, sf_dir, "buildings").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("area_m2").alias("area"))
    return graph.dedup_within(points, 40.0).select("id", "component")


@own("""WITH RECURSIVE k AS (SELECT r, c, qa, r * 100 + c AS id FROM pixels WHERE qa > 0), links AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.qa = b.qa AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
    reach AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), n AS (SELECT a AS id, count(*) AS n FROM reach GROUP BY a)
    SELECT p.r, p.c, CASE WHEN n.n < 3 THEN 0 ELSE p.qa END AS k FROM pixels p LEFT JOIN n ON n.id = p.r * 100 + p.c""")
def islands_dropped(spark, sf_dir):
    return graph.drop_islands(frame(spark, sf_dir, "pixels").select("r", "c", F.col("qa").alias("k")), 100, 3, 0)


TILES = "SELECT ty * 5 AS ty, tx * 5 AS tx FROM (SELECT unnest(range(0, (SELECT greatest(100, max(r) + 1) - 10 FROM pixels) // 5 + 1)) AS ty) a CROSS JOIN (SELECT unnest(range(0, 19)) AS tx) b"


@own(f"SELECT CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, round(avg(CASE WHEN qa = 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM pixels JOIN ({TILES}) t ON r BETWEEN ty AND ty + 9 AND c BETWEEN tx AND tx + 9 GROUP BY 1, 2 HAVING avg(CASE WHEN qa = 0 THEN 1.0 ELSE 0.0 END) >= 0.55")
def covered_tiles(spark, sf_dir):
    mask = frame(spark, sf_dir, "pixels").select("r", "c", F.when(F.col("qa") == 0, 1.0).otherwise(0.0).alias("m"))
    return rounded(overlay.covered_tiles(mask, 10, 5, rows_of(mask), 100), "coverage")


@own(f"""WITH v AS (SELECT r, c, ty * 100 + tx AS tile, (ty + 2 * tx) // 5 % 4 AS k, ((ty * 3 + tx * 7) % 100) / CAST(100 AS DOUBLE) AS conf, ((ty + tx) % 60) / CAST(100 AS DOUBLE) AS base
        FROM pixels JOIN ({TILES}) t ON r BETWEEN ty AND ty + 9 AND c BETWEEN tx AND tx + 9),
    n AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY k <> 0 AND conf >= 0.4 AND conf - base >= 0.125 DESC, conf DESC, tile) AS place FROM v)
    SELECT r, c, CAST(CASE WHEN k <> 0 AND conf >= 0.4 AND conf - base >= 0.125 THEN k ELSE 0 END AS INT) AS k FROM n WHERE place = 1""")
def confident_overlay(spark, sf_dir):
    pixels = frame(spark, sf_dir, "pixels").select("r", "c")
    tiles = overlay.on_tiles(pixels, 10, 5, rows_of(pixels), 100)
    votes = tiles.select("r", "c", F.expr("ty * 100 + tx").alias("tile"), F.expr("(ty + 2 * tx) div 5 % 4").cast("int").alias("k"), F.expr("((ty * 3 + tx * 7) % 100) / 100D").alias("conf"), F.expr("((ty + tx) % 60) / 100D").alias("base"))
    return overlay.confident(votes, 0, 0.4, 0.125)


@own("""WITH p AS (SELECT p_partkey AS id, j, (p_partkey * (j + 1) % 11 + p_size * (j + 2) % 7 + (p_partkey + j) % 5) / CAST(3 AS DOUBLE) * CASE j WHEN 1 THEN 0.5 WHEN 3 THEN 1.5 ELSE 1.0 END AS v
        FROM part CROSS JOIN (SELECT unnest(range(0, 5)) AS j) k), t AS (SELECT id, j, v, sum(v) OVER (PARTITION BY id) AS whole FROM p)
    SELECT id, CAST(j AS INT) AS k, round(CASE WHEN whole > 0 THEN v / whole ELSE v END, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, j) AS n FROM t) x WHERE n = 1""")
def averaged_classes(spark, sf_dir):
    sizes = {"p0": "p_partkey * (j + 1) % 11", "p1": "p_size * (j + 2) % 7", "p2": "(p_partkey + j) % 5"}
    rows = frame(spark, sf_dir, "part").withColumns({n: F.expr(f"transform(sequence(0, 4), j -> cast({e} AS double))") for n, e in sizes.items()})
    rows = rows.withColumn("p", overlay.averaged(list(sizes), [1.0, 0.5, 1.0, 1.5, 1.0]))
    best = overlay.first_best(F.transform("p", lambda x: F.round(x, 9)))
    return rows.select(F.col("p_partkey").alias("id"), best.alias("k"), F.round(F.array_max("p"), 6).alias("p"))


# polygons on the pixel grid
GRID = (PIXEL, 0.0, 0.0, 0.0, PIXEL, 0.0)


def polygon(*points: tuple[str, str]) -> Column:
    """One polygon of one ring through points given as SQL."""
    return F.array(F.array(F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in points))))


@own(f"SELECT b.id, count(*) AS n, round(avg(p.st), 3) AS mean FROM buildings b JOIN pixels p ON abs((p.c + 0.5) * {PIXEL} - (x0 + x1) / 2) + abs((p.r + 0.5) * {PIXEL} - (y0 + y1) / 2) < (x1 - x0) * CAST(0.61 AS DOUBLE) GROUP BY b.id")
def diamond_zonal_mean(spark, sf_dir):
    x, y, h = "(x0 + x1) / 2", "(y0 + y1) / 2", "(x1 - x0) * 0.61D"
    zones = frame(spark, sf_dir, "buildings").select("id", polygon((x, f"{y} - {h}"), (f"{x} + {h}", y), (x, f"{y} + {h}"), (f"{x} - {h}", y)).alias("polygons"))
    pixels = frame(spark, sf_dir, "pixels").select("r", "c", "st")
    rows = rasterize.zonal(pixels, zones, GRID, rows_of(pixels), 100)
    return rounded(rows.groupBy("id").agg(F.count("*").alias("n"), F.avg("st").alias("mean")), "mean", digits=3)


@own("""WITH a AS (SELECT unnest(range(CAST(floor(x0 / 7.5) AS BIGINT), CAST(ceil(x1 / 7.5) AS BIGINT))) AS x, y0, y1 FROM buildings WHERE material = 'building'),
    b AS (SELECT DISTINCT x, y FROM (SELECT x, unnest(range(CAST(floor(y0 / 7.5) AS BIGINT), CAST(ceil(y1 / 7.5) AS BIGINT))) AS y FROM a) t WHERE x < 400 AND y < 4 * (SELECT greatest(100, max(r) + 1) FROM pixels))
    SELECT CAST(y // 4 AS INT) AS r, CAST(x // 4 AS INT) AS c, count(*) / CAST(16 AS DOUBLE) AS fraction FROM b GROUP BY 1, 2""")
def supersampled_fraction(spark, sf_dir):
    zones = frame(spark, sf_dir, "buildings").where("material = 'building'").select(polygon(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")).alias("polygons"))
    return rasterize.fractions(zones, GRID, rows_of(frame(spark, sf_dir, "pixels")), 100, supersample=4)


@own("""WITH b AS (SELECT area_m2 AS w, CASE WHEN slope < 40 THEN slope / 45 END AS v1, slope / 90 AS v2, slope - 20 AS v3 FROM buildings),
    u AS (SELECT 'ndvi' AS parameter, v1 AS v, w FROM b UNION ALL SELECT 'albedo', v2, w FROM b UNION ALL SELECT 'ndbi', v3, w FROM b)
    SELECT parameter, count(v) AS valid_roofs, round(avg(v), 6) AS unweighted_mean, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS area_weighted_mean FROM u GROUP BY parameter""")
def green_roof_parameters(spark, sf_dir):
    means = {"mean_ndvi": "CASE WHEN slope < 40 THEN slope / 45 END", "mean_albedo": "slope / 90", "mean_ndbi": "slope - 20"}
    roofs = frame(spark, sf_dir, "buildings").select(F.col("area_m2").alias("roof_area_m2"), *(F.expr(e).alias(n) for n, e in means.items()))
    return rounded(scenario.summary(roofs), "unweighted_mean", "area_weighted_mean")


@own("""SELECT 'all' AS scope, count(*) AS n, round(avg(d), 6) AS mean, round(sum(d * area_m2) / sum(area_m2), 6) AS weighted, round(max(d), 6) AS most FROM (SELECT *, slope / 45 - 0.5 AS d FROM buildings) b
    UNION ALL SELECT 'selected', count(*), round(avg(d), 6), round(sum(d * area_m2) / sum(area_m2), 6), round(max(d), 6) FROM (SELECT *, slope / 45 - 0.5 AS d FROM buildings WHERE material = 'building') b""")
def cooling_statistics(spark, sf_dir):
    rows = frame(spark, sf_dir, "buildings").select("id", F.expr("slope / 45 - 0.5").alias("cooling_mean"), F.col("area_m2").alias("roof_area_m2"), F.expr("material = 'building'").alias("selected_for_greening"))
    found = [(scope, *values[:4]) for scope, values in scenario.building_statistics(rows).items()]
    return rounded(spark.createDataFrame(found, "scope string, n long, mean double, weighted double, most double"), "mean", "weighted", "most")
