"""Operators on rasters as tables of pixels (r, c, bands); missing values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scale and offset of surface temperature and of surface reflectance, and of the quality bits.
ST_SCALE, ST_OFFSET, KELVIN = 0.00341802, 149.0, 273.15
SR_SCALE, SR_OFFSET = 0.0000275, -0.2
INVALID_BITS, WATER_BIT = 0b111111, 1 << 7


def clear(qa: str = "qa", keep_water: bool = False) -> Column:
    """Whether none of the bits 0 to 5 is set, nor bit 7 unless water is kept."""
    return F.col(qa).bitwiseAND(F.lit(INVALID_BITS if keep_water else INVALID_BITS | WATER_BIT)) == 0


def surface_temperature(pixels: DataFrame, keep_water: bool = False, celsius: bool = True) -> DataFrame:
    """pixels with lst: the scaled thermal band where the quality bits are clear."""
    value = F.col("st") * ST_SCALE + (ST_OFFSET - KELVIN if celsius else ST_OFFSET)
    return pixels.withColumn("lst", F.when(clear(keep_water=keep_water), value))


def _ratio(a: Column, b: Column) -> Column:
    x = (a - b) / (a + b + 1e-6)
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def indices(pixels: DataFrame) -> DataFrame:
    """pixels with ndvi, albedo and ndbi from the scaled reflectance bands."""
    blue, red, nir, swir1, swir2 = (F.col(b) * SR_SCALE + SR_OFFSET for b in ("b2", "b4", "b5", "b6", "b7"))
    albedo = 0.356 * blue + 0.130 * red + 0.373 * nir + 0.085 * swir1 + 0.072 * swir2 - 0.0018
    return pixels.withColumns({"ndvi": _ratio(nir, red), "albedo": F.when(albedo.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), albedo))), "ndbi": _ratio(swir1, nir)})


def block_mean(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """(r, c, mean) of size x size blocks."""
    return pixels.groupBy(F.floor(F.col("r") / size).cast("int").alias("r"), F.floor(F.col("c") / size).cast("int").alias("c")).agg(F.avg(value).alias("mean"))


def dilate(mask: DataFrame, by: int, rows: int, columns: int) -> DataFrame:
    """(r, c) of a mask grown by a square of 2 by + 1, within the frame."""
    steps = F.sequence(F.lit(-by), F.lit(by))
    grown = mask.select("r", "c", F.explode(steps).alias("dr")).select("r", "c", "dr", F.explode(steps).alias("dc"))
    grown = grown.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    return grown.where(f"r between 0 and {rows - 1} and c between 0 and {columns - 1}").distinct()


def windows(spark, height: int, width: int, tile: int = 192, stride: int = 96) -> DataFrame:
    """(y, x) of sliding tiles, with tiles flush to the right and bottom edges; starts below zero become zero."""

    def starts(extent: int) -> list[int]:
        last = max(0, extent - tile)
        return sorted({*range(0, last + 1, stride), last})

    ys = spark.createDataFrame([(y,) for y in starts(height)], "y int")
    return ys.withColumn("x", F.explode(F.array(*(F.lit(x) for x in starts(width)))))


def window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """pixels of rows r0 to r1 and columns c0 to c1, ends included; the bounds reach a scan of pixel rows."""
    return pixels.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def register(bands: dict[str, DataFrame]) -> DataFrame:
    """(r, c, names) of bands, each (r, c, v), where all have a pixel; they meet in one aggregation."""
    whole = None
    for name, band in bands.items():
        band = band.select("r", "c", F.lit(name).alias("_n"), "v")
        whole = band if whole is None else whole.unionByName(band)
    met = whole.groupBy("r", "c").agg(F.count("*").alias("_count"), *(F.max(F.when(F.col("_n") == n, F.col("v"))).alias(n) for n in bands))
    return met.where(F.col("_count") == len(bands)).drop("_count")


def mosaic(*layers: DataFrame) -> DataFrame:
    """(r, c, bands) of layers with the same bands; the first layer that has a pixel gives it."""
    whole = None
    for i, layer in enumerate(layers):
        layer = layer.select(F.lit(i).alias("_layer"), *layers[0].columns)
        whole = layer if whole is None else whole.unionByName(layer)
    rest = [c for c in layers[0].columns if c not in ("r", "c")]
    return whole.groupBy("r", "c").agg(F.min_by(F.struct(*rest), "_layer").alias("_x")).select("r", "c", *(f"_x.{c}" for c in rest))


def difference(baseline: DataFrame, other: DataFrame, value: str, within: DataFrame | None = None) -> DataFrame:
    """(r, c, difference) of baseline less other, two rasters on one grid, null where either is; only cells of within(r, c) if given."""
    right = other.select("r", "c", F.col(value).alias("_other"))
    out = baseline.select("r", "c", F.col(value).alias("_base")).join(right, ["r", "c"])
    out = out.select("r", "c", (F.col("_base") - F.col("_other")).alias("difference"))
    return out if within is None else out.join(within.select("r", "c").distinct(), ["r", "c"], "left_semi")


def tumbling(pixels: DataFrame, size: int) -> DataFrame:
    """pixels with ty and tx, the number of the tile that holds them; tiles at the edge may be smaller."""
    return pixels.withColumns({"ty": F.floor(F.col("r") / size).cast("int"), "tx": F.floor(F.col("c") / size).cast("int")})


def covariance(mask: DataFrame) -> DataFrame:
    """(cxy, cxx, cyy) of the columns and rows of mask(r, c), those of a sample; their first eigenvector is the main axis."""
    return mask.agg(F.covar_samp("c", "r").alias("cxy"), F.var_samp("c").alias("cxx"), F.var_samp("r").alias("cyy"))


# Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)


def grey_mask(blue: Column, green: Column, red: Column, least: float = 5) -> Column:
    """1 where the rounded grey value is above `least`, else 0."""
    grey = F.round(F.lit(GREY[0]) * blue + F.lit(GREY[1]) * green + F.lit(GREY[2]) * red)
    return (grey > least).cast("int")


def stretched(pixels: DataFrame, band: str, low: float, high: float, name: str = "v", nonzero: bool = False, fewest: int = 100, extremes: bool = False) -> DataFrame:
    """pixels with a band stretched from its percentiles low and high to 0..255, cut off below the next whole number.

    With nonzero the percentiles are those of values that are not 0, and 0 and 255 where there are fewer than `fewest`; with extremes, least and
    greatest take their place where they are equal.
    """
    v = F.col(band)
    of = F.when(v != 0, v) if nonzero else v
    ends = pixels.agg(F.percentile(of, F.lit(low)).alias("lo"), F.percentile(of, F.lit(high)).alias("hi"), F.count(of).alias("n"), F.min(v).alias("a"), F.max(v).alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    if nonzero:
        lo, hi = F.when(F.col("n") < fewest, 0.0).otherwise(lo), F.when(F.col("n") < fewest, 255.0).otherwise(hi)
    if extremes:
        lo, hi = F.when(F.col("hi") <= F.col("lo"), F.col("a")).otherwise(lo), F.when(F.col("hi") <= F.col("lo"), F.col("b")).otherwise(hi)
    ends = ends.select(lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi"))
    share = (v - F.col("_lo")) / F.greatest(F.lit(1e-6), F.col("_hi") - F.col("_lo"))
    value = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return pixels.join(F.broadcast(ends)).withColumn(name, value).drop("_lo", "_hi")


def resample(pixels: DataFrame, values: list[str], source: tuple[float, ...], target: tuple[float, ...], height: int, width: int) -> DataFrame:
    """(r, c, values) on a target grid by bilinear interpolation from pixels(r, c, values) on a source grid; transforms are (a, b, c, d, e, f).

    A target pixel takes the four source pixels around its centre, weighted by nearness, of those that are known; a value none of whose
    pixels is known is null, and so is one whose nearest pixel is not known. Each source pixel is dealt to the target pixels whose centres lie
    within one source pixel of its own, an aggregation on (r, c), so no grid is held whole. Grids may not be rotated against each other.
    """
    if any(abs(t[1]) + abs(t[3]) > 0 for t in (source, target)):
        raise ValueError("rotated grids are not resampled")
    (a, _, c, _, e, f), (ta, _, tc, _, te, tf) = source, target

    def reach(index: str, step: float, start: float, t_step: float, t_start: float, extent: int) -> Column:
        ends = [(start + (F.col(index) + k) * step - t_start) / t_step - 0.5 for k in (-0.5, 1.5)]
        first, last = F.greatest(F.lit(0), F.ceil(F.least(*ends)).cast("int")), F.least(F.lit(extent - 1), F.floor(F.greatest(*ends)).cast("int"))
        return F.when(last >= first, F.sequence(first, last))

    def weight(index: str, step: float, start: float, t_index: str, t_step: float, t_start: float) -> Column:
        at = (t_start + (F.col(t_index) + 0.5) * t_step - start) / step - 0.5
        return F.greatest(F.lit(0.0), 1 - F.abs(at - F.col(index)))

    dealt = pixels.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *values)
    dealt = dealt.withColumn("r", F.explode(reach("_r", e, f, te, tf, height))).withColumn("c", F.explode(reach("_c", a, c, ta, tc, width)))
    dealt = dealt.withColumns({"_wr": weight("_r", e, f, "r", te, tf), "_wc": weight("_c", a, c, "c", ta, tc)}).withColumn("_w", F.round(F.col("_wr") * F.col("_wc"), 12)).where("_w > 0")
    near = (F.col("_wr") >= 0.5) & (F.col("_wc") >= 0.5)
    sums = dealt.groupBy("r", "c").agg(*(x for v in values for x in (F.try_divide(F.sum(F.col(v) * F.col("_w")), F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v), F.max(F.when(near & F.col(v).isNotNull(), 1)).alias(f"_near_{v}"))))
    return sums.select("r", "c", *(F.when(F.col(f"_near_{v}") == 1, F.col(v)).alias(v) for v in values))
