"""Tiles over masks and classes: coverage, the most confident class, averaged probabilities and kept pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(at: str, size: int, stride: int, extent: int) -> Column:
    """Starts, multiples of stride, of the full tiles within the extent that hold a pixel."""
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / stride)).cast("int")
    last = F.least(F.lit((extent - size) // stride), F.floor(F.col(at) / stride)).cast("int")
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i * stride))


def on_tiles(pixels: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """pixels repeated for each tile (ty, tx) over them, at most (size / stride + 1)**2 times."""
    return pixels.withColumn("ty", F.explode(_starts("r", size, stride, height))).withColumn("tx", F.explode(_starts("c", size, stride, width)))


def covered_tiles(mask: DataFrame, size: int, stride: int, height: int, width: int, least: float = 0.55) -> DataFrame:
    """(ty, tx, coverage) of tiles whose mean of mask(r, c, m) is at least `least`."""
    tiles = on_tiles(mask, size, stride, height, width).groupBy("ty", "tx").agg(F.avg("m").alias("coverage"))
    return tiles.where(F.col("coverage") >= least)


def confident(votes: DataFrame, default: int, least: float, margin: float) -> DataFrame:
    """(r, c, k) from votes(r, c, tile, k, conf, base): the most confident class that is not the default, reaches `least`, beats
    base, the default's confidence, by `margin` and is above it; the earliest tile wins ties. Pixels without one keep the default."""
    conf, base = F.col("conf"), F.col("base")
    counts = (F.col("k") != default) & (conf >= least) & (conf - base >= margin) & (conf > base)
    best = F.max(F.when(counts, F.struct("conf", (-F.col("tile")).alias("early"), "k")))
    return votes.groupBy("r", "c").agg(F.coalesce(best["k"], F.lit(default)).alias("k"))


def averaged(probabilities: list[str], priors: list[float]) -> Column:
    """Mean of equally long probability arrays times the priors, scaled to sum 1 where the sum is positive."""
    total = F.col(probabilities[0])
    for name in probabilities[1:]:
        total = F.zip_with(total, F.col(name), lambda a, b: a + b)
    scaled = F.zip_with(total, F.array(*map(F.lit, priors)), lambda a, p: a / len(probabilities) * p)
    whole = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)
    return F.transform(scaled, lambda x: F.when(whole > 0, x / whole).otherwise(x))


def first_best(values: Column) -> Column:
    """Position from 0 of the greatest element, the first of equals; null for an empty array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _all_starts(extent: Column, size: int, stride: int) -> Column:
    """Starts of sliding tiles over an extent, the last flush with its end; 0 alone where the tile is longer."""
    last = F.greatest(F.lit(0), extent - size)
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))


def padded_tiles(mask: DataFrame, size: int, stride: int, pad: int = 0, least: float = 0.55) -> DataFrame:
    """(chip, y0, x0, y1, x1, coverage) of sliding tiles over chips whose part of the roof, with a margin of `pad` within the chip, is enough.

    mask(chip, r, c, m, height, width) has m 1 on the roof; pixels that it lacks count as 0. Tiles at the lower and right edge are flush
    with it. A pixel meets the few tiles over it by an equality join on the cell of its chip.
    """
    chips = mask.groupBy("chip").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    tiles = chips.withColumn("y0", F.explode(_all_starts(F.col("height"), size, stride))).withColumn("x0", F.explode(_all_starts(F.col("width"), size, stride)))
    tiles = tiles.withColumns({"y1": F.least("height", F.col("y0") + size), "x1": F.least("width", F.col("x0") + size)})
    tiles = tiles.withColumns({"_r0": F.greatest(F.lit(0), F.col("y0") - pad), "_c0": F.greatest(F.lit(0), F.col("x0") - pad), "_r1": F.least("height", F.col("y1") + pad), "_c1": F.least("width", F.col("x1") + pad)})
    cell = size + 2 * pad
    on = tiles.withColumn("_cy", F.explode(F.sequence((F.col("_r0") / cell).cast("int"), ((F.col("_r1") - 1) / cell).cast("int"))))
    on = on.withColumn("_cx", F.explode(F.sequence((F.col("_c0") / cell).cast("int"), ((F.col("_c1") - 1) / cell).cast("int"))))
    roof = mask.where("m > 0").select("chip", "r", "c", "m", (F.col("r") / cell).cast("int").alias("_cy"), (F.col("c") / cell).cast("int").alias("_cx"))
    met = on.join(roof, ["chip", "_cy", "_cx"]).where("r >= _r0 and r < _r1 and c >= _c0 and c < _c1")
    sums = met.groupBy("chip", "y0", "x0", "y1", "x1", "_r0", "_c0", "_r1", "_c1").agg(F.sum("m").alias("_m"))
    share = F.col("_m") / ((F.col("_r1") - F.col("_r0")) * (F.col("_c1") - F.col("_c0")))
    return sums.withColumn("coverage", share).where(F.col("coverage") >= least).select("chip", "y0", "x0", "y1", "x1", "coverage")
