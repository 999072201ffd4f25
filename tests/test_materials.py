"""Votes of tiles, class maps and summaries against plain versions."""

import numpy as np
import pytest

from rastrel.operators import materials, smooth

NAMES, PRIORS = ["one", "two"], [1.0, 0.5, 2.0]


def test_tile_votes(spark):
    rng, size, stride, pad = np.random.default_rng(4), 8, 6, 2
    roof = {"a": rng.random((21, 17)) < 0.7, "b": rng.random((5, 30)) < 0.5}
    mask = [(c, y, x, int(m[y, x]), *m.shape) for c, m in roof.items() for y in range(m.shape[0]) for x in range(m.shape[1]) if m[y, x]]
    corners = [(c, y, x) for c in roof for y in range(0, 30) for x in range(0, 30)]
    given = {k: rng.dirichlet(np.ones(3), 2) for k in corners}
    given["a", 0, 0] = np.zeros((2, 3))
    probabilities = spark.createDataFrame([(*k, p[0].tolist(), p[1].tolist()) for k, p in given.items()], "chip string, y0 int, x0 int, one array<double>, two array<double>")
    want = {}
    for chip, m in roof.items():
        h, w = m.shape
        starts = [sorted({*range(0, max(0, n - size) + 1, stride), max(0, n - size)}) for n in (h, w)]
        for y in starts[0]:
            for x in starts[1]:
                y1, x1 = min(h, y + size), min(w, x + size)
                if m[max(0, y - pad) : y1 + pad, max(0, x - pad) : x1 + pad].mean() >= 0.55:
                    p = given[chip, y, x].mean(axis=0) * PRIORS
                    p = p / p.sum() if p.sum() > 0 else p
                    want[chip, y, x] = (y1, x1, int(p.argmax()), p)
    table = spark.createDataFrame(mask, "chip string, r int, c int, m int, height int, width int")
    found = {(t.chip, t.y0, t.x0): t for t in materials.tile_votes(table, probabilities, NAMES, PRIORS, size, stride, pad).collect()}
    assert found.keys() == want.keys() and len(found) > 5
    for at, (y1, x1, k, p) in want.items():
        assert (found[at].y1, found[at].x1, found[at].k) == (y1, x1, k)
        assert found[at].p == pytest.approx(p) and found[at].conf == pytest.approx(p.max())
    assert materials.tile_votes(table.limit(0), probabilities, NAMES, PRIORS, size, stride, pad).count() == 0


def test_class_map(spark):
    mask = spark.createDataFrame([(c, y, x) for c in "ab" for y in range(10) for x in range(10)], "chip string, r int, c int")
    defaults = spark.createDataFrame([("a", 2, 0.6), ("b", 1, 0.9)], "chip string, k int, conf double")
    tiles = [
        ("a", 0, 0, 5, 5, 0, 0.95, 0.2),
        ("a", 0, 3, 5, 8, 3, 0.90, 0.2),  # loses to the tile above where both lie
        ("a", 6, 0, 8, 2, 4, 0.99, 0.1),  # an island of four pixels
        ("a", 5, 5, 10, 10, 0, 0.80, 0.1),  # not confident enough
        ("a", 5, 5, 10, 10, 3, 0.90, 0.7),  # too near to the default
        ("b", 0, 0, 5, 5, 0, 0.89, 0.1),  # below the roof's own class
    ]
    tiles = spark.createDataFrame(tiles, "chip string, y0 int, x0 int, y1 int, x1 int, k int, conf double, base double")
    want = {("a", y, x): 0 if y < 5 and x < 5 else 3 if y < 5 and x < 8 else 2 for y in range(10) for x in range(10)}
    want |= {("b", y, x): 1 for y in range(10) for x in range(10)}
    found = materials.class_map(mask, defaults, tiles, island=5, smooth_axis=False)
    assert {(p.chip, p.r, p.c): p.k for p in found.collect()} == want
    whole = materials.class_map(mask, defaults, tiles, island=4, smooth_axis=False)
    assert {(p.r, p.c) for p in whole.where("k = 4").collect()} == {(6, 0), (6, 1), (7, 0), (7, 1)}
    smoothed = {(p.chip, p.r, p.c): p.k for p in materials.class_map(mask, defaults, tiles, island=5).collect()}
    # square roofs have no axis of their own, so corners may be turned out of the frame (-1): each chip is as the filter leaves it
    for chip in "ab":
        plain = smooth.smoothed(np.array([[want[chip, y, x] for x in range(10)] for y in range(10)]), np.ones((10, 10), int))
        assert [[smoothed[chip, y, x] for x in range(10)] for y in range(10)] == plain.tolist()
    assert {smoothed["b", y, x] for y in range(3, 7) for x in range(3, 7)} == {1}


def test_summaries(spark):
    rows = [("a", 0, 50), ("a", 3, 30), ("a", 1, 10), ("a", 4, 10), ("a", -1, 900), ("b", 2, 5), ("b", 4, 5), ("c", -1, 7), ("d", 0, 0)]
    counts = spark.createDataFrame(rows, "chip string, k int, px long")
    found = {s.chip: s for s in materials.summaries(counts).collect()}
    # glass (1) needs 0.09 of the roof and a fifth of the largest cover; classes become ids of materials by name
    assert found["a"].materials == ["0", "3", "2", "4"] and found["a"].cover == pytest.approx([0.5, 0.3, 0.1, 0.1]) and found["a"].roof_px == 100
    assert found["b"].materials == ["1", "4"] and found.keys() == {"a", "b"}
    assert {s.chip: s.materials for s in materials.summaries(counts, priors={3: 2.0}, most=2).collect()} == {"a": ["3", "0"], "b": ["1", "4"]}
    named = {s.chip: s for s in materials.dominant(materials.summaries(counts)).collect()}
    assert named["a"].dominant_material == "0" and named["a"].n_materials == 4
