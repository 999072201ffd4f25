"""The scenario and the roof parameters from files that are made here."""

import json

import numpy as np
import pytest

from rastrel import __main__ as command
from rastrel.plans import scenario
from rastrel.sources import geotiff

AT = (30.0, 0.0, 500000.0, 0.0, -30.0, 4100000.0)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scene")
    (folder / "l2").mkdir()
    rng = np.random.default_rng(4)
    shape = (40, 50, 1)
    bands = {n: rng.integers(8000, 15000, shape) for n in ("b2", "b4", "b5", "b6", "b7")}
    red, nir = (bands[b] * 0.0000275 - 0.2 for b in ("b4", "b5"))
    bands["st"] = np.rint((30 - 6 * (nir - red) / (nir + red + 1e-6) + 273.15 - 149.0) / 0.00341802).astype(int)
    bands["qa"] = np.zeros(shape, int)
    bands["qa"][0, :5] = 8
    for name, end in scenario.BANDS.items():
        (folder / "l2" / f"scene{end}").write_bytes(geotiff.encode(bands[name].astype("uint16"), AT, 32632, 0.0 if name != "qa" else None))
    features = []
    for i in range(30):
        x, y = AT[2] + 60 + 45 * i, AT[5] - 60 - 35 * i
        ring = [[x, y], [x + 50, y], [x + 50, y - 40], [x, y - 40], [x, y]]
        features.append({"type": "Feature", "properties": {"gml_id": f"b{i}", "material": "concrete" if i % 2 else "['Tar_Paper']"}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
    (folder / "buildings.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return folder


@pytest.mark.parametrize("kind", ["linear", "rf"])
def test_scenario(spark, inputs, tmp_path, kind):
    config = scenario.Scenario(str(inputs / "l2"), str(inputs / "buildings.geojson"), str(tmp_path), "material", "tar_paper", lonlat=False, model=kind, trees=10, min_sample_spacing=0.0, sample_frac=1.0, target_ndvi=0.9, tiles=kind == "linear")
    pixels, buildings = scenario.run(spark, config)
    rows = buildings.collect()
    assert len(rows) == 30 and sum(r.selected_for_greening for r in rows) == 15
    assert all(r.cooling_mean > 0 for r in rows if r.selected_for_greening) and rows[0].roof_area_m2 == 2000
    assert pixels.where("fraction = 0 and delta <> 0").count() == 0 and pixels.where("lst is null and delta is not null").count() == 0
    assert config.metrics["r2_test"] > (0.999 if kind == "linear" else 0.5)
    report = "".join(p.read_text() for p in (tmp_path / "greening_statistics").glob("part*"))
    assert "Buildings selected for greening: 15" in report and "nan" not in report
    if kind == "linear":
        again = geotiff.read_pixels(spark, str(tmp_path / "delta"))
        assert again.where("v is not null").count() == pixels.where("delta is not null").count()


def test_parameters_and_commands(spark, inputs, tmp_path, capsys):
    command.main(["roof-parameters", "--l2-folder", str(inputs / "l2"), "--green-roofs", str(inputs / "buildings.geojson"), "--no-lonlat", "--out", str(tmp_path / "o"), "--summary-csv", str(tmp_path / "s")])
    got = {r.parameter: r for r in spark.read.csv(str(tmp_path / "s"), header=True, inferSchema=True).collect()}
    assert sorted(got) == ["albedo", "ndbi", "ndvi"] and got["ndvi"].valid_roofs == 30
    assert got["ndvi"].unweighted_mean == pytest.approx(got["ndvi"].area_weighted_mean)
    command.main(["green-roof-query", "--bbox", "1,2,3,4"])
    assert "(1.0,2.0,3.0,4.0)" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        scenario.read_scene(spark, str(inputs / "l2"), {"x": "_NONE.TIF"})
    for wrong in ({}, {"roof_materials_type": "a", "model": "x"}, {"max_roof_slope_deg": -1.0}, {"roof_materials_type": "a", "sample_frac": 0}):
        with pytest.raises(ValueError):
            scenario.Scenario("a", "b", **wrong)


def test_projection_of_a_layer(spark):
    rows = spark.createDataFrame([([[[(9.0, -10.0), (9.001, -10.0), (9.001, -9.999)]]],)], "polygons array<array<array<struct<x:double,y:double>>>>")
    south = scenario.projected(rows, 32732, True).first().polygons[0][0][0]
    north = scenario.projected(rows, 32632, True).first().polygons[0][0][0]
    assert south.y - north.y == pytest.approx(10_000_000) and north.y < 0 and south.x == pytest.approx(500000)
    with pytest.raises(ValueError):
        scenario.projected(rows, 2154, True)


def test_bands_on_another_grid_are_resampled(spark, inputs, tmp_path):
    import shutil

    folder = tmp_path / "l2"
    shutil.copytree(inputs / "l2", folder)
    # a plane on a grid of half pixels, shifted by a quarter: bilinear values of the first grid are exact
    fine = (15.0, 0.0, AT[2] + 3.75, 0.0, -15.0, AT[5] - 3.75)
    plane = np.fromfunction(lambda r, c, b: 10 * c + 4 * r, (80, 100, 1))
    (folder / f"scene{scenario.BANDS['b5']}").write_bytes(geotiff.encode(plane.astype("float32"), fine, 32632, None))
    pixels, meta = scenario.read_scene(spark, str(folder))
    assert (meta["width"], meta["a"]) == (50, 30.0)
    for row in pixels.where("r between 1 and 38 and c between 1 and 48").collect():
        x, y = (row.c + 0.5) * 30 - 3.75, (row.r + 0.5) * 30 - 3.75
        assert row.b5 == pytest.approx(10 * (x / 15 - 0.5) + 4 * (y / 15 - 0.5), abs=1e-5)


def test_buildings_with_one_id_keep_their_own_means(spark, inputs, tmp_path):
    layer = json.loads((inputs / "buildings.geojson").read_text())
    for feature in layer["features"]:
        feature["properties"]["gml_id"] = "same"
    (tmp_path / "same.geojson").write_text(json.dumps(layer))
    config = scenario.Scenario(str(inputs / "l2"), str(tmp_path / "same.geojson"), str(tmp_path / "out"), "material", "tar_paper", lonlat=False, model="linear", min_sample_spacing=0.0, sample_frac=1.0, target_ndvi=0.9)
    rows = scenario.run(spark, config)[1].collect()
    assert len(rows) == 30 and sum(r.selected_for_greening for r in rows) == 15 and len({r.lst_baseline_mean for r in rows}) > 25


def test_resampling_skips_missing_pixels(spark):
    from rastrel.operators import raster

    rows = [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 7.0)]
    pixels = spark.createDataFrame(rows, "r int, c int, v double")
    half = {(x.r, x.c): x.v for x in raster.resample(pixels, ["v"], (2.0, 0.0, 0.0, 0.0, 2.0, 0.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 4, 4).collect()}
    assert half[0, 0] == 1 and half[3, 3] == 7 and half[0, 3] is None and half[1, 1] == pytest.approx((9 * 1 + 3 * 3 + 7) / 13)


def test_ready_temperature_and_named_layer(spark, inputs, tmp_path):
    import pyarrow as pa

    from rastrel.sources import geopackage

    features = json.loads((inputs / "buildings.geojson").read_text())["features"]
    rows = [{"gml_id": f["properties"]["gml_id"], "material": f["properties"]["material"], "polygons": [[[{"x": x, "y": y} for x, y in ring] for ring in f["geometry"]["coordinates"]]]} for f in features]
    (tmp_path / "b.gpkg").write_bytes(geopackage.encode(pa.Table.from_pylist(rows), "roofs", 32632))
    ready = np.fromfunction(lambda r, c, b: 20 + r * 0.1 + c * 0.05, (40, 50, 1)).astype("float32")
    ready[5, 5] = np.nan
    (tmp_path / "lst.tif").write_bytes(geotiff.encode(ready, AT, 32632, np.nan))
    given = ["scenario", "--l2_folder", str(inputs / "l2"), "--buildings", str(tmp_path / "b.gpkg"), "--layer", "roofs", "--lst", str(tmp_path / "lst.tif"), "--out_dir", str(tmp_path / "out"), "--roof_material_field", "material", "--roof_materials_type", "tar_paper", "--no-lonlat", "--model", "linear", "--min_sample_spacing", "0", "--sample_frac", "1"]
    command.main(given)
    pixels = {(x.r, x.c): x for x in spark.read.parquet(str(tmp_path / "out" / "pixels")).collect()}
    assert all(x.lst == pytest.approx(float(ready[k[0], k[1], 0])) for k, x in pixels.items() if x.lst is not None) and pixels[5, 5].lst is None and pixels[5, 5].ndvi is None
    built = scenario.Scenario(str(inputs / "l2"), "b", roof_materials_type="a")
    plain = {(x.r, x.c): x.ndvi for x in scenario.baseline(spark, built)[0].collect()}
    assert all(x.ndvi == pytest.approx(plain[k]) for k, x in pixels.items() if x.ndvi is not None and plain[k] is not None)
    with pytest.raises(ValueError, match="temperature raster"):
        scenario.Scenario("a", "b", roof_materials_type="a", build_lst=False)
