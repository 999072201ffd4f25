"""The greening scenario and the parameters of green roofs from files: one Landsat scene and a layer of buildings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import model, raster, rasterize, select
from ..sources import files, geopackage, geotiff

# Ends of the names of a scene's bands.
BANDS = {"st": "_ST_B10.TIF", "qa": "_QA_PIXEL.TIF", "b2": "_SR_B2.TIF", "b4": "_SR_B4.TIF", "b5": "_SR_B5.TIF", "b6": "_SR_B6.TIF", "b7": "_SR_B7.TIF"}
PARAMETERS = ("ndvi", "albedo", "ndbi")


@dataclass
class Scenario:
    """Settings of a run; ValueError for those that contradict."""

    l2_folder: str
    buildings: str
    out_dir: str = "results_greening"
    roof_material_field: str | None = "predictedrooftypematerial"
    roof_materials_type: str | None = None
    roof_shape_field: str | None = None
    roof_shape_type: str | None = None
    roof_slope_field: str | None = "roof_slope_mean_deg"
    max_roof_slope_deg: float | None = None
    boundary: str | None = None
    lonlat: bool = True
    id_field: str = "gml_id"
    lst_unit: str = "celsius"
    keep_lst_water: bool = False
    target_ndvi: float | None = 0.4
    target_albedo: float = 0.20
    target_ndbi: float = -0.15
    sample_frac: float = 0.1
    min_sample_spacing: float = 100.0
    random_state: int = 42
    model: str = "rf"
    trees: int = 500
    supersample: int = 4
    all_touched: bool = False
    keep_null_roof: bool = False
    min_roof_area: float = 0.0
    clip_positive_delta: bool = False
    tiles: bool = False
    lst: str | None = None
    build_lst: bool | None = None
    layer: str | None = None
    metrics: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = {
            "a roof material, shape or slope is required": not (_listed(self.roof_materials_type) or _listed(self.roof_shape_type) or self.max_roof_slope_deg is not None),
            "a temperature raster is needed where none is built": self.build_lst is False and not self.lst,
            "lst_unit must be celsius or kelvin": self.lst_unit not in ("celsius", "kelvin"),
            "model must be linear or rf": self.model not in ("linear", "rf"),
            "sample_frac must be above 0 and at most 1": not 0 < self.sample_frac <= 1,
            "min_sample_spacing, min_roof_area and max_roof_slope_deg must not be negative": min(self.min_sample_spacing, self.min_roof_area, self.max_roof_slope_deg or 0) < 0,
            "supersample must be 1 or more": self.supersample < 1,
            "target_ndvi and target_ndbi must be from -1 to 1, target_albedo from 0 to 1": not (-1 <= (self.target_ndvi or 0) <= 1 and -1 <= self.target_ndbi <= 1 and 0 <= self.target_albedo <= 1),
        }
        if found := [text for text, holds in wrong.items() if holds]:
            raise ValueError("; ".join(found))


def _listed(text: str | None) -> list[str]:
    return [x.strip().lower() for x in (text or "").split(",") if x.strip()]


def read_scene(spark: SparkSession, folder: str, names: dict[str, str] = BANDS, grid: dict | None = None) -> tuple[DataFrame, dict]:
    """(r, c, bands) of a scene's files, one per band, and the grid, given or that of the first band, as a dict of geotiff.read_meta.

    A band on another grid of the same reference system is resampled to it; quality bits cannot be, and must share it. The bands meet in one aggregation on (r, c). FileNotFoundError for a band that is missing, ValueError for
    one that comes twice, has no transform or another reference system.
    """
    found = {n: geotiff.one_band(spark, folder, end) or geotiff.one_band(spark, folder, end.replace(".TIF", ".tif")) for n, end in names.items()}
    if missing := [names[n] for n, path in found.items() if path is None]:
        raise FileNotFoundError(f"no file below {folder} ends with {missing}")
    metas = {n: meta_of(spark, path) for n, path in found.items()}
    grid = grid or next(iter(metas.values()))
    if any(m["a"] is None or m["epsg"] != grid["epsg"] for m in metas.values()) or metas.get("qa", grid) != grid:
        raise ValueError("bands need a transform and one reference system, and the quality bits the grid of the first band")
    whole = None
    for name, path in found.items():
        band = geotiff.read_pixels(spark, path).where("band = 0").select("r", "c", "v")
        if metas[name] != grid:
            band = raster.resample(band, ["v"], grid_of(metas[name])[0], *grid_of(grid))
        band = band.select("r", "c", F.lit(name).alias("n"), "v")
        whole = band if whole is None else whole.unionByName(band)
    picked = whole.groupBy("r", "c").agg(*(F.max(F.when(F.col("n") == n, F.col("v"))).alias(n) for n in names))
    return picked.withColumn("qa", F.col("qa").cast("int")) if "qa" in names else picked, grid


def meta_of(spark: SparkSession, path: str) -> dict:
    """Size, reference system and transform of one raster."""
    return geotiff.read_meta(spark, path).drop("file", "nodata", "bands").first().asDict()


def baseline(spark: SparkSession, config: Scenario) -> tuple[DataFrame, dict]:
    """(r, c, lst, indices) and the grid: the temperature is built from the scene, or it is a ready raster, to whose grid the scene's bands are resampled."""
    if config.build_lst or not config.lst:
        scene, meta = read_scene(spark, config.l2_folder)
        return raster.indices(raster.surface_temperature(scene, config.keep_lst_water, config.lst_unit == "celsius")), meta
    meta = meta_of(spark, config.lst)
    bands, _ = read_scene(spark, config.l2_folder, {n: end for n, end in BANDS.items() if n not in ("st", "qa")}, meta)
    ready = geotiff.read_pixels(spark, config.lst).where("band = 0").select("r", "c", F.col("v").alias("lst"))
    return raster.indices(ready.join(bands, ["r", "c"], "left")), meta


def grid_of(meta: dict) -> tuple[tuple[float, ...], int, int]:
    """Transform, height and width."""
    return tuple(meta[k] for k in "abcdef"), meta["height"], meta["width"]


def projected(features: DataFrame, epsg: int | None, lonlat: bool) -> DataFrame:
    """features with polygons in the raster's system: from degrees to its UTM zone or to EPSG:3857, else as they are."""
    if not lonlat or epsg == 4326:
        return features
    if epsg == 3857:
        return features.withColumn("polygons", scalars.moved("polygons", lambda x, y: scalars.mercator(x, y)))
    if epsg is None or not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 or 25828 <= epsg <= 25838):
        raise ValueError(f"degrees cannot be brought to EPSG:{epsg}")
    south = 10_000_000.0 if epsg // 100 == 327 else 0.0

    def move(x: Column, y: Column) -> tuple[Column, Column]:
        east, north = scalars.utm(x, y, epsg % 100)
        return east, north + F.when(y < 0, south - 10_000_000.0).otherwise(south)

    return features.withColumn("polygons", scalars.moved("polygons", move))


def features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(file, ordinal, properties, polygons) of a GeoPackage's layer, the first if none is named, or of GeoJSON collections."""
    if path.lower().endswith(".gpkg"):
        return geopackage.read_layer(spark, path, layer).select("file", F.col("fid").alias("ordinal"), "properties", "polygons")
    return files.read_geojson(spark, path)


def read_layer(spark: SparkSession, path: str, epsg: int | None, lonlat: bool, id_field: str, *fields: str | None, layer: str | None = None) -> DataFrame:
    """(id, fields, polygons, roof_area_m2) of polygons of area above 0; ids are the property, else file and place."""
    rows = projected(features(spark, path, layer), epsg, lonlat)
    ident = F.coalesce(F.col("properties").getItem(id_field), F.concat_ws("#", "file", "ordinal"))
    rows = rows.select(ident.alias("id"), *(F.col("properties").getItem(x).alias(x) for x in dict.fromkeys(filter(None, fields))), "polygons")
    return rows.withColumn("roof_area_m2", scalars.polygons_area("polygons")).where("roof_area_m2 > 0")


def within(pixels: DataFrame, spark: SparkSession, meta: dict, layer: DataFrame, boundary: str | None, lonlat: bool) -> DataFrame:
    """pixels inside the boundary's polygons, or without one inside the box around the layer."""
    transform, height, width = grid_of(meta)
    if boundary:
        shape = projected(features(spark, boundary), meta["epsg"], lonlat).select("polygons")
        return pixels.join(rasterize.cells(shape.withColumn("polygons", rasterize.on_grid("polygons", transform)), height, width).distinct(), ["r", "c"], "left_semi")
    points = F.flatten(F.flatten(rasterize.on_grid("polygons", transform)))
    ends = layer.select(F.explode(points).alias("p")).agg(*(f("p." + k) for k in "xy" for f in (F.min, F.max))).first()
    if ends[0] is None:
        raise ValueError("the layer has no polygons")
    return pixels.where((F.col("c") >= math.floor(ends[0])) & (F.col("c") < math.ceil(ends[1])) & (F.col("r") >= math.floor(ends[2])) & (F.col("r") < math.ceil(ends[3])))


def sampled(rows: DataFrame, share: float, spacing: float, pixel: float, seed: int) -> DataFrame:
    """Complete rows thinned to one a block of the spacing, of which the share, 1000 or all are taken by seeded order."""
    rows = model.complete(rows)
    if spacing > 0:
        rows = model.thin(rows, max(1, round(spacing / pixel)), seed)
    n = rows.count()
    if n < 6:
        raise ValueError("at least 6 complete pixels are needed")
    return model.sample(rows, share, seed)


def run(spark: SparkSession, config: Scenario) -> tuple[DataFrame, DataFrame]:
    """Pixels (r, c, lst, indices, fraction, delta, scenario) and buildings (id, ..., lst_baseline_mean, delta_mean, cooling_mean,
    selected_for_greening, polygons), written with reports below config.out_dir and read again."""
    out = config.out_dir.rstrip("/")
    pixels, meta = baseline(spark, config)
    transform, height, width = grid_of(meta)
    layer = read_layer(spark, config.buildings, meta["epsg"], config.lonlat, config.id_field, config.roof_material_field, config.roof_shape_field, config.roof_slope_field, layer=config.layer)
    # a feature is known by its row, since ids may repeat; the numbers are fixed by being written
    layer.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{out}/layer")
    layer = spark.read.parquet(f"{out}/layer")
    chosen = select.subset(
        layer, material=(config.roof_material_field, _listed(config.roof_materials_type)) if _listed(config.roof_materials_type) else None,
        shape=(config.roof_shape_field, _listed(config.roof_shape_type)) if _listed(config.roof_shape_type) else None,
        slope=(config.roof_slope_field, config.max_roof_slope_deg) if config.max_roof_slope_deg is not None else None, keep_null=config.keep_null_roof,
    ).where(F.col("roof_area_m2") >= config.min_roof_area)
    if chosen.isEmpty():
        raise ValueError("no buildings match")
    pixels = within(pixels, spark, meta, layer, config.boundary, config.lonlat)
    pixels = pixels.select("r", "c", "lst", *(F.when(F.col("lst").isNotNull(), F.col(x)).alias(x) for x in PARAMETERS))
    pixels.write.mode("overwrite").parquet(f"{out}/baseline")
    pixels = spark.read.parquet(f"{out}/baseline")
    targets = {"ndvi": config.target_ndvi, "albedo": config.target_albedo, "ndbi": config.target_ndbi}
    if config.target_ndvi is None:
        targets["ndvi"] = model.green_target(pixels).first().target
    rows = model.split(sampled(pixels, config.sample_frac, config.min_sample_spacing, math.sqrt(abs(transform[0] * transform[4] - transform[1] * transform[3])), config.random_state), 0.8, config.random_state)
    train = rows.where("part = 'train'")
    fitted = model.fit_linear(train) if config.model == "linear" else model.fit_forest(train, trees=config.trees, seed=config.random_state)
    config.metrics = model.quality(model.with_prediction(rows, fitted))
    share = rasterize.fractions(chosen, transform, height, width, config.supersample, config.all_touched)
    changed = (model.scenario if config.model == "linear" else model.forest_scenario)(pixels, share, targets, fitted, config.clip_positive_delta)
    changed.write.mode("overwrite").parquet(f"{out}/pixels")
    changed = spark.read.parquet(f"{out}/pixels")
    means = rasterize.zonal(changed.select("r", "c", "lst", "delta"), layer.select("row", "polygons"), transform, height, width, all_touched=True)
    means = means.groupBy("row").agg(F.avg("lst").alias("lst_baseline_mean"), F.avg("delta").alias("delta_mean"))
    flags = chosen.select("row").withColumn("selected_for_greening", F.lit(True))
    buildings = layer.join(means, "row", "left").join(flags, "row", "left").drop("row").withColumn("selected_for_greening", F.coalesce("selected_for_greening", F.lit(False)))
    buildings = buildings.withColumn("cooling_mean", -F.col("delta_mean"))
    buildings.write.mode("overwrite").parquet(f"{out}/buildings")
    buildings = spark.read.parquet(f"{out}/buildings")
    files.write_geojson_lines(buildings, f"{out}/buildings_greening_impact", mode="overwrite")
    if config.tiles:
        for name in ("lst", "delta", "scenario"):
            geotiff.save_files(geotiff.encode_tiles(changed, [name], transform, epsg=meta["epsg"]), f"{out}/{name}", overwrite=True)
    names = dict(zip(PARAMETERS, fitted.featureImportances, strict=True)) if config.model == "rf" else {x: fitted[x] for x in PARAMETERS}
    write_lines(spark, model_report(config, names), f"{out}/model_feature_importance")
    write_lines(spark, statistics_report(changed, buildings), f"{out}/greening_statistics")
    write_lines(spark, provenance_report(config, targets), f"{out}/greening_provenance")
    return changed, buildings


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A short report as one text file below path."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def shown(value: float | None, digits: int = 4) -> str:
    """A number with so many decimals; 'nan' for null and what is not finite."""
    return "nan" if value is None or not math.isfinite(value) else f"{value:.{digits}f}"


def model_report(config: Scenario, names: dict[str, float]) -> list[str]:
    """Fit by part, and the weight of each input."""
    m = config.metrics
    scores = [f"{title} {part}: {shown(m.get(f'{key}_{part}'), 6)}" for title, key in (("R2", "r2"), ("RMSE", "rmse")) for part in ("train", "test")]
    title = "Random Forest feature importances (sum=1):" if config.model == "rf" else "Linear model coefficients:"
    return [f"Model: {config.model}", *scores, "", title, *(f"{n}: {shown(v)}" for n, v in names.items())]


def building_statistics(buildings: DataFrame) -> dict[str, tuple]:
    """(n, mean, area-weighted mean, greatest cooling, its id) over all buildings with a mean and over the selected ones, in one aggregation."""
    x, w = F.col("cooling_mean"), F.col("roof_area_m2")
    known = x.isNotNull()
    out = []
    for test in (known, known & F.col("selected_for_greening")):
        pick = lambda v, test=test: F.when(test, v)
        out += [F.count(pick(x)), F.avg(pick(x)), F.try_divide(F.sum(pick(x * w)), F.sum(pick(w))), F.max(pick(x)), F.min_by("id", pick(F.struct(-x, F.col("id"))))]
    row = buildings.agg(*(c.alias(f"s{i}") for i, c in enumerate(out))).first()
    return {"all": tuple(row[:5]), "selected": tuple(row[5:])}


def statistics_report(pixels: DataFrame, buildings: DataFrame) -> list[str]:
    """Cooling of the raster, of all buildings and of the selected ones."""
    cooling = pixels.agg(F.avg(F.col("lst") - F.col("scenario"))).first()[0]
    stats = building_statistics(buildings)
    counts = buildings.agg(F.count("*"), F.count_if("selected_for_greening")).first()
    lines = ["Greening statistics", "-------------------", f"Raster mean (baseline - scenario): {shown(cooling)} °C", f"Buildings in analysis: {counts[0]}", f"Buildings selected for greening: {counts[1]}"]
    for title, key in (("All buildings (city-wide dilution/impact):", "all"), ("Buildings selected for greening (with valid statistics):", "selected")):
        _, mean, weighted, most, ident = stats[key]
        lines += [title, f"  Average cooling: {shown(mean)} °C", f"  Area-weighted average cooling: {shown(weighted)} °C", f"  Max cooling: {shown(most)} °C" + (f" (id={ident})" if ident else "")]
    return lines


def provenance_report(config: Scenario, targets: dict[str, float]) -> list[str]:
    """Every setting, the targets used and the scores."""
    settings = {k: v for k, v in vars(config).items() if k != "metrics"} | {f"target_{k}": v for k, v in targets.items()} | config.metrics
    return [f"{k}: {v}" for k, v in settings.items()]


def roof_parameters(spark: SparkSession, l2_folder: str, roofs: str, *, lonlat: bool = True, id_field: str = "gml_id", all_touched: bool = True, mask_with_lst: bool = True, keep_water: bool = False, drop_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Roofs (id, polygons, roof_area_m2, mean_ndvi, mean_albedo, mean_ndbi) and their summary (parameter, valid_roofs, unweighted_mean,
    area_weighted_mean)."""
    scene, meta = read_scene(spark, l2_folder)
    transform, height, width = grid_of(meta)
    pixels = raster.indices(raster.surface_temperature(scene, keep_water))
    if mask_with_lst:
        pixels = pixels.withColumns({x: F.when(F.col("lst").isNotNull(), F.col(x)) for x in PARAMETERS})
    layer = read_layer(spark, roofs, meta["epsg"], lonlat, id_field)
    rows = rasterize.zonal(pixels.select("r", "c", *PARAMETERS), layer.select("id", "polygons"), transform, height, width, all_touched)
    means = rows.groupBy("id").agg(*(F.avg(x).alias(f"mean_{x}") for x in PARAMETERS))
    out = layer.join(means, "id", "left")
    if drop_missing:
        out = out.na.drop(subset=[f"mean_{x}" for x in PARAMETERS])
    return out, summary(out)


def summary(roofs: DataFrame) -> DataFrame:
    """(parameter, valid_roofs, unweighted_mean, area_weighted_mean) of mean_ and each parameter, in one aggregation."""
    long = roofs.select("roof_area_m2", F.explode(F.create_map(*(x for n in PARAMETERS for x in (F.lit(n), F.col(f"mean_{n}"))))).alias("parameter", "v"))
    w = F.when(F.col("v").isNotNull() & (F.col("roof_area_m2") > 0), F.col("roof_area_m2"))
    return long.groupBy("parameter").agg(F.count("v").alias("valid_roofs"), F.avg("v").alias("unweighted_mean"), F.try_divide(F.sum(F.col("v") * w), F.sum(w)).alias("area_weighted_mean"))
