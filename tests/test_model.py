"""Forest, split, metrics and smoothing on small cases."""

import numpy as np
import pytest

from rastrel.operators import model, smooth


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(5)
    rows = [(r, c, *map(float, rng.random(3))) for r in range(40) for c in range(25)]
    rows = [(r, c, (30 - 8 * a + 3 * b) if (r, c) != (3, 3) else None, a, b, d) for r, c, a, b, d in rows]
    return spark.createDataFrame([*rows, (50, 0, 20.0, None, 0.1, 0.1)], "r int, c int, lst double, ndvi double, albedo double, ndbi double").cache()


def test_split_and_forest(spark, pixels):
    rows = model.split(model.complete(pixels))
    n = rows.count()
    assert n == 999 and rows.where("part = 'train'").count() == int(0.8 * n)
    fitted = model.fit_forest(rows.where("part = 'train'"), trees=20, depth=8)
    found = model.quality(model.with_prediction(rows, fitted))
    assert found["r2_train"] > found["r2_test"] > 0.8 and found["rmse_test"] < 1.2
    assert sum(fitted.featureImportances) == pytest.approx(1) and fitted.featureImportances[0] > 0.5
    line = model.quality(model.with_prediction(rows, model.fit_linear(rows)))
    assert line["r2_test"] == pytest.approx(1)
    everything = model.with_prediction(pixels, fitted)
    assert everything.count() == pixels.count() and everything.where("prediction is null").count() == 1
    fractions = spark.createDataFrame([(0, 0, 1.0), (3, 3, 0.5), (50, 0, 1.0)], "r int, c int, fraction double")
    changed = {(x.r, x.c): x for x in model.forest_scenario(pixels, fractions, {"ndvi": 0.95, "albedo": 0.05, "ndbi": 0.5}, fitted).collect()}
    assert len(changed) == pixels.count() and changed[0, 0].delta != 0 and changed[0, 0].scenario == pytest.approx(changed[0, 0].lst + changed[0, 0].delta)
    assert changed[3, 3].delta is None and changed[1, 1].delta == 0 and changed[50, 0].delta is None


def test_split_of_few_rows(spark, pixels):
    assert model.split(pixels.limit(0)).count() == 0
    same = spark.createDataFrame([(1, 1)] * 10, "r int, c int")
    assert model.split(same).where("part = 'train'").count() == 8


def test_box_sums():
    values = np.arange(35).reshape(5, 7) % 3 == 0
    got = smooth.box_sums(values, 3, 5)
    for r in range(5):
        for c in range(7):
            assert got[r, c] == values[max(0, r - 1) : r + 2, max(0, c - 2) : c + 3].sum()


def test_smoothing(spark):
    rows = [(chip, r, c, 1 if r < 10 else 2, 1) for chip in (1, 2) for r in range(20) for c in range(60)]
    rows = [(chip, r, c, 0 if (r, c) in {(4, 20), (15, 40)} else k, 0 if (chip, r, c) == (2, 0, 0) else m) for chip, r, c, k, m in rows]
    got = {(x.chip, x.r, x.c): x.k for x in smooth.smooth_classes(spark.createDataFrame(rows, "chip long, r int, c int, k int, m int")).collect()}
    assert got[1, 4, 20] == 1 and got[1, 15, 40] == 2 and got[2, 0, 0] == -1 and len(got) == 2400
    slanted = np.fromfunction(lambda r, c: abs(r - c) < 8, (80, 80)).astype(int)
    assert abs(abs(smooth.main_angle(slanted)) % 180 - 45) < 1e-6
    out = smooth.smoothed(np.where(slanted, 3, -1), slanted)
    assert (out[slanted == 0] == -1).all() and (out[30:50, 30:50][slanted[30:50, 30:50] == 1] == 3).mean() > 0.95
