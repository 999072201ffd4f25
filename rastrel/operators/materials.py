"""From class probabilities of roof tiles to materials of buildings: overlay, islands, smoothing, coverage, ranking and the best chip."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import canonical_label
from . import graph, overlay, smooth

# Ids of materials, and the least cover of a class beside the largest, by the classifier's index; glass counts half again.
TARGET_ID = {"concrete": 0, "metal": 1, "glass": 2, "roof_tiles": 3, "tar_paper": 4}
LEAST_COVER = {0: 0.02, 1: 0.06, 2: 0.15, 3: 0.03, 4: 0.03}
CLASSES = ("concrete", "glass", "metal", "roof_tiles", "tar_paper")
GLASS_TIMES, RELATIVE = 1.5, 0.20


def _by_class(values: Mapping[int, float], default: float) -> Column:
    """A class's value, or the default."""
    out = F.lit(float(default))
    for k, v in values.items():
        out = F.when(F.col("k") == k, F.lit(float(v))).otherwise(out)
    return out


def thresholds(least: float, classes: Sequence[str] = CLASSES) -> dict[int, float]:
    """Least cover of each class as a second material."""
    return {k: max(least, LEAST_COVER.get(k, least)) * (GLASS_TIMES if name == "glass" else 1.0) for k, name in enumerate(classes)}


def covered(counts: DataFrame, own: Mapping[int, float], least: float = 0.02, relative: float = RELATIVE) -> DataFrame:
    """(chip, k, frac, top) of counts(chip, k, px): the largest class of each chip, the lowest of equals, and those with enough
    cover, in itself and beside the largest. Classes below 0 and empty ones are left out."""
    chip = Window.partitionBy("chip")
    rows = counts.where("k >= 0 and px > 0").select("chip", "k", (F.col("px") / F.sum("px").over(chip)).alias("frac"))
    rows = rows.withColumns({"_most": F.max("frac").over(chip), "_place": F.row_number().over(chip.orderBy(F.desc("frac"), "k"))})
    stays = (F.col("_place") == 1) | ((F.col("frac") >= _by_class(own, least)) & (F.col("frac") >= relative * F.col("_most")))
    return rows.where(stays).select("chip", "k", "frac", (F.col("_place") == 1).alias("top"))


def ranked(candidates: DataFrame, priors: Mapping[int, float] | None = None, classes: Sequence[str] | None = None, most: int = 0) -> DataFrame:
    """candidates(chip, k, frac) with score, material_id and rank: by cover times prior, the lowest class of equals, `most` at most or all.

    With names of classes, each is mapped to its material's id by its canonical label, and classes of no known material go; without,
    material_id is k.
    """
    rows = candidates.withColumn("score", F.col("frac") * _by_class(priors or {}, 1.0))
    if classes is None:
        rows = rows.withColumn("material_id", F.col("k"))
    else:
        names = F.array(*map(F.lit, classes))
        known = F.create_map(*(F.lit(x) for pair in TARGET_ID.items() for x in pair))
        rows = rows.withColumn("material_id", F.element_at(known, canonical_label(F.get(names, F.col("k"))))).where("material_id is not null")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("chip").orderBy(F.desc("score"), "k")))
    return rows.where(F.col("rank") <= most) if most else rows


def summaries(counts: DataFrame, least: float = 0.05, classes: Sequence[str] = CLASSES, priors: Mapping[int, float] | None = None, most: int = 5) -> DataFrame:
    """(chip, materials, cover, roof_px): ids as strings and shares of each chip's materials, the first first."""
    found = ranked(covered(counts, thresholds(least, classes), least), priors, classes, most)
    lists = found.groupBy("chip").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("material_id").cast("string").alias("id"), "frac"))).alias("x"))
    sums = counts.where("k >= 0").groupBy("chip").agg(F.sum("px").alias("roof_px"))
    return lists.join(sums, "chip").select("chip", F.col("x.id").alias("materials"), F.col("x.frac").alias("cover"), "roof_px")


def dominant(summary: DataFrame, drop_unclassified: bool = False) -> DataFrame:
    """summary(materials, cover, ...) with dominant_material, dominant_material_cov and n_materials; null, null and 0 without a material,
    or such rows dropped."""
    some = F.coalesce(F.size("materials") > 0, F.lit(False))
    rows = summary.where(some) if drop_unclassified else summary
    first = lambda c: F.when(some, F.get(F.col(c), F.lit(0)))
    return rows.withColumns({"dominant_material": first("materials"), "dominant_material_cov": first("cover"), "n_materials": F.when(some, F.size("materials")).otherwise(0)})


def histogram(rows: DataFrame, field: str = "dominant_material") -> DataFrame:
    """(field, n) by descending count, null left out."""
    return rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)


def best_chip(chips: DataFrame, building: str, px: str = "px", chip: str = "chip") -> DataFrame:
    """The chip of most roof pixels of each building, the earliest of equals; one aggregation."""
    rest = [c for c in chips.columns if c not in (building, px, chip)]
    best = F.min(F.struct((-F.col(px)).alias("_less"), chip, *rest))
    found = chips.groupBy(building).agg(best.alias("x"))
    return found.select(building, f"x.{chip}", (-F.col("x._less")).alias(px), *(f"x.{c}" for c in rest))


def class_map(mask: DataFrame, defaults: DataFrame, tiles: DataFrame, least: float = 0.86, margin: float = 0.28, island: int = 200, long: int = 45, short: int = 5, smooth_axis: bool = True) -> DataFrame:
    """(chip, r, c, k) of roof pixels mask(chip, r, c): the chip's default class, overridden by confident tiles, small islands undone, smoothed.

    defaults(chip, k, conf) is the class of the whole roof; tiles(chip, y0, x0, y1, x1, k, conf, base) the best class of each tile with
    enough roof, in the order of their corners, and the default's confidence there. A tile overrides where its confidence reaches `least`,
    beats the default's by `margin` and is above what the pixel has. A chip is one group of the smoothing, the size of a building's image.
    """
    good = tiles.join(defaults.select("chip", F.col("k").alias("_dk"), F.col("conf").alias("_dc")), "chip")
    good = good.where((F.col("k") != F.col("_dk")) & (F.col("conf") >= least) & (F.col("conf") - F.col("base") >= margin) & (F.col("conf") > F.col("_dc")))
    spread = good.withColumn("r", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("c", F.explode(F.sequence("x0", F.col("x1") - 1)))
    best = spread.groupBy("chip", "r", "c").agg(F.max(F.struct("conf", (-F.col("y0")).alias("a"), (-F.col("x0")).alias("b"), "k")).alias("_best"))
    rows = mask.select("chip", "r", "c").join(best, ["chip", "r", "c"], "left").join(defaults.select("chip", F.col("k").alias("default")), "chip")
    rows = rows.select("chip", "r", "c", F.coalesce("_best.k", "default").alias("k"), "default")
    kept = graph.drop_small_regions(rows, island)
    return smooth.smooth_classes(kept.withColumn("m", F.lit(1)), long, short) if smooth_axis else kept.select("chip", "r", "c", "k")


def tile_votes(mask: DataFrame, probabilities: DataFrame, names: list[str], priors: list[float], size: int, stride: int, pad: int, coverage: float = 0.55) -> DataFrame:
    """(chip, y0, x0, y1, x1, k, conf, p) of the tiles over mask(chip, r, c, m, height, width) whose padded part is roof enough.

    probabilities(chip, y0, x0, names...) holds the class probabilities that a classifier gives a tile at several scales, which are
    averaged, weighed by the priors and scaled.
    """
    found = overlay.padded_tiles(mask, size, stride, pad, coverage)
    rows = found.join(probabilities, ["chip", "y0", "x0"]).withColumn("p", overlay.averaged(names, priors))
    return rows.select("chip", "y0", "x0", "y1", "x1", overlay.first_best(F.col("p")).alias("k"), F.array_max("p").alias("conf"), "p")
