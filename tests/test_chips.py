"""Chips, patches and training files against plain versions."""

import numpy as np
import pytest

from rastrel.operators import chips
from rastrel.sources import files, geotiff

AT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
ZONES = "id int, polygons array<array<array<struct<x:double,y:double>>>>"


def box(x0, y0, x1, y1):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


@pytest.mark.parametrize("bands", [1, 4])
def test_chips(spark, bands):
    rng = np.random.default_rng(2)
    image = rng.integers(1, 900, (30, 40, bands)).astype(float)
    image[20:, 20:] = 0
    rows = [(r, c, b, float(image[r, c, b])) for r in range(30) for c in range(40) for b in range(bands)]
    pixels = spark.createDataFrame(rows, "r int, c int, band int, v double")
    zones = spark.createDataFrame([(0, box(2.5, 2.5, 18.5, 16.5)), (1, box(5.2, 5.2, 6.8, 6.8)), (2, box(24.5, 24.5, 38.5, 29.5))], ZONES)
    found = chips.chips(pixels, zones, AT, 30, 40, bands, grown=2, fewest=50)
    out = {r.name: geotiff.Raster(bytes(r.content)) for r in chips.chip_files(found, "a", AT, 30, 40).collect()}
    assert list(out) == ["a_b000.tif"]  # the second is small, the third black
    chip = np.zeros_like(image)
    chip[0:19, 0:21] = image[0:19, 0:21]
    lo, hi = np.percentile(chip, 1), np.percentile(chip, 99)
    want = (np.clip((chip - lo) / (hi - lo), 0, 1) * 255).astype(np.uint8)
    want = np.repeat(want, 3, axis=2) if bands == 1 else want[:, :, :3]
    got = np.zeros_like(want)
    for row, column, band, values in out["a_b000.tif"].blocks():
        got[row : row + values.shape[0], column : column + values.shape[1], band : band + values.shape[2]] = values
    assert (got == want).all()


@pytest.mark.parametrize("partial", [False, True])
def test_patches(spark, partial):
    height, width, size, stride = 23, 31, 8, 5
    found = chips.patch_windows(spark, height, width, size, stride, partial).orderBy("patch_id").collect()
    ends = (height, width) if partial else (height - size + 1, width - size + 1)
    plain = [(x, y, min(size, width - x), min(size, height - y)) for y in range(0, ends[0], stride) for x in range(0, ends[1], stride)]
    assert [(r.x, r.y, r.w, r.h) for r in found] == plain and found[1].name == "patch_000001_x5_y0.tif"
    pixels = spark.createDataFrame([(r, c) for r in range(height) for c in range(width)], "r int, c int")
    got = {(x.r, x.c, x.x, x.y) for x in chips.patches(pixels, height, width, size, stride, partial).collect()}
    assert got == {(y + i, x + j, x, y) for x, y, w, h in plain for i in range(h) for j in range(w)}
    assert chips.patch_windows(spark, 4, 4, 8, 5).count() == 0


def test_training_files(spark, tmp_path):
    for name in ("a/x.png", "a/x.tif", "b/y.jpg", "b/z.gif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    images = files.list_files(spark, str(tmp_path))
    assert images.count() == 3
    labels = spark.createDataFrame([("x", 1), ("y", 0), ("z", 1), ("w", None), ("x", 9)], "stem string, class_id int")
    for text in ("nc: 2\nnames: [tiles, 'tar paper']\n", "names:\n  - tiles\n  - tar paper # dark\nnc: 2\n", "names:\n  1: tar paper\n  0: tiles\n", "names: {0: tiles, 1: \"tar paper\"}"):
        (tmp_path / "n.yaml").write_text(text)
        names = files.read_class_names(spark, str(tmp_path / "n.yaml"))
        assert sorted(map(tuple, names.collect())) == [(0, "tiles"), (1, "tar paper")]
    assert {(r.file[-7:], r.target) for r in chips.training_files(labels, images, names).collect()} == {("a/x.tif", "tar paper/x.tif"), ("b/y.jpg", "tiles/y.jpg")}
    assert {r.target for r in chips.training_files(labels, images).collect()} == {"1/x.tif", "0/y.jpg", "9/x.tif"}
