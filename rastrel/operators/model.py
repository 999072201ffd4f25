"""Regression over pixels by normal equations or a forest, seeded samples, and the counterfactual on selected roofs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import top_one

INPUTS = ("ndvi", "albedo", "ndbi")


# A prime, and multipliers of the seeded order.
PRIME, TIMES_R, TIMES_C = 2_147_483_647, 73_856_093, 19_349_663


def order_key(seed: int) -> Column:
    """A portable integer hash of (r, c) below PRIME, squared so that its order follows no lattice."""
    h = (F.col("r").cast("long") * TIMES_R + F.col("c").cast("long") * TIMES_C + seed) % PRIME
    return (h * h + F.col("r") * 31 + F.col("c")) % PRIME


def thin(pixels: DataFrame, block: int, seed: int) -> DataFrame:
    """One pixel of each block x block square, by seeded order."""
    rows = pixels.withColumns({"_br": F.floor(F.col("r") / block), "_bc": F.floor(F.col("c") / block)})
    return top_one(rows, ["_br", "_bc"], order_key(seed), F.col("r"), F.col("c")).drop("_br", "_bc")


def complete(pixels: DataFrame, target: str = "lst") -> DataFrame:
    """Rows where the target and all inputs are known."""
    return pixels.where(" and ".join(f"{x} is not null" for x in (target, *INPUTS)))


def fit_linear(rows: DataFrame, target: str = "lst") -> dict[str, float]:
    """Least squares coefficients by name, with `intercept`: means and covariances in one aggregation, solved on the driver."""
    pairs = [(a, b) for i, a in enumerate(INPUTS) for b in (*INPUTS[i:], target)]
    found = rows.agg(*(F.avg(x).alias(x) for x in (*INPUTS, target)), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    normal = np.array([[found[f"{a}_{b}"] if (a, b) in pairs else found[f"{b}_{a}"] for b in INPUTS] for a in INPUTS])
    weights = np.linalg.lstsq(normal, np.array([found[f"{a}_{target}"] for a in INPUTS]), rcond=None)[0]
    out = dict(zip(INPUTS, map(float, weights), strict=True))
    return out | {"intercept": float(found[target] - sum(out[x] * found[x] for x in INPUTS))}


def predict(model: dict[str, float], inputs: dict[str, Column] | None = None) -> Column:
    """The model's value; null where an input is."""
    inputs = inputs or {x: F.col(x) for x in INPUTS}
    return sum((inputs[x] * model[x] for x in INPUTS), F.lit(model["intercept"]))


def blended(targets: dict[str, float], fraction: str = "fraction") -> dict[str, Column]:
    """Inputs moved toward their targets by a roof fraction, clipped to 0..1."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(fraction)))
    return {x: (1 - f) * F.col(x) + f * F.lit(targets[x]) for x in INPUTS}


def scenario(pixels: DataFrame, fractions: DataFrame, targets: dict[str, float], model: dict[str, float], clip_positive: bool = False) -> DataFrame:
    """pixels(r, c, lst, inputs) with fraction, delta and scenario: the modelled change on pixels with selected roofs, 0 elsewhere."""
    rows = pixels.join(fractions, ["r", "c"], "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    change = predict(model, blended(targets)) - predict(model)
    if clip_positive:
        change = F.least(F.lit(0.0), change)
    return rows.withColumn("delta", F.when(F.col("lst").isNotNull(), F.when(F.col("fraction") > 0, change).otherwise(0.0))).withColumn("scenario", F.col("lst") + F.col("delta"))


def first_share(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """rows(r, c, ...) with _first: whether a row is one of the first n by seeded order, then r and c.

    Rows are counted by cells of the order, of which there are a million at most; only those of the cell at the border are sorted, and
    the last row that counts decides for all, so no row moves.
    """
    cell, place = (order_key(seed) / 2048).cast("long"), F.struct(order_key(seed).alias("k"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    counts = rows.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("_before", before).where(F.col("_before") < n).orderBy(F.desc("_before")).limit(1).first()
    if edge is None:
        return rows.withColumn("_first", F.lit(False))
    border = rows.where(cell == edge["_cell"]).select(place.alias("p")).orderBy("p").limit(n - edge["_before"])
    last = border.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("p")).first()
    end = F.struct(*(F.lit(last.p[x]).cast("long").alias(x) for x in "krc"))
    if rows.where(place == end).count() == last.n:
        return rows.withColumn("_first", place <= end)
    # several rows stand at the last place, and not all of them count
    ties = rows.where(place == end).withColumn("_first", F.row_number().over(Window.partitionBy("r", "c").orderBy("r")) <= last.n)
    return rows.where(place != end).withColumn("_first", place < end).union(ties)


def sample(rows: DataFrame, share: float, seed: int = 42, least: int = 1000) -> DataFrame:
    """max(least, floor(share * n)) of rows(r, c, ...) by seeded order, or all."""
    return first_share(rows, max(least, int(share * rows.count())), seed).where("_first").drop("_first")


def split(rows: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """rows(r, c, ...) with part: 'train' for floor(share * n) rows by seeded order, 'test' for the rest."""
    marked = first_share(rows, int(share * rows.count()), seed)
    return marked.withColumn("part", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def green_target(pixels: DataFrame, value: str = "ndvi", least: float = 0.3, default: float = 0.5) -> DataFrame:
    """(target): the median of a value above `least` where the temperature is known, or the default without any."""
    green = F.when((F.col(value) > least) & F.col("lst").isNotNull(), F.col(value))
    return pixels.agg(F.coalesce(F.percentile(green, F.lit(0.5)), F.lit(default)).alias("target"))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(INPUTS), outputCol="_x", handleInvalid="error").transform(rows)


def fit_forest(rows: DataFrame, target: str = "lst", trees: int = 500, depth: int = 12, least: int = 5, seed: int = 42) -> RandomForestRegressionModel:
    """A random forest on complete rows; a split looks at the square root of the number of inputs."""
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="sqrt", maxBins=128, seed=seed)
    return forest.fit(_assembled(rows))


def with_prediction(rows: DataFrame, model: dict[str, float] | RandomForestRegressionModel) -> DataFrame:
    """rows with prediction; null where an input is null, and those rows are not given to a forest."""
    if isinstance(model, dict):
        return rows.withColumn("prediction", predict(model))
    known = " and ".join(f"{x} is not null" for x in INPUTS)
    scored = model.transform(_assembled(rows.where(known))).drop("_x")
    return scored.unionByName(rows.where(f"not ({known})").withColumn("prediction", F.lit(None).cast("double")))


def forest_scenario(pixels: DataFrame, fractions: DataFrame, targets: dict[str, float], model: RandomForestRegressionModel, clip_positive: bool = False) -> DataFrame:
    """As scenario, with a forest: only pixels with selected roofs are predicted, before and after."""
    rows = pixels.join(fractions, ["r", "c"], "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    roofed = complete(rows.where("fraction > 0")).select("r", "c", *INPUTS, "fraction")
    now = with_prediction(roofed, model).withColumnRenamed("prediction", "_now")
    then = with_prediction(now.select("r", "c", "_now", *(e.alias(x) for x, e in blended(targets).items())), model)
    change = F.col("prediction") - F.col("_now")
    if clip_positive:
        change = F.least(F.lit(0.0), change)
    changes = then.select("r", "c", change.alias("_change"))
    delta = F.when(F.col("lst").isNotNull(), F.when(F.col("fraction") > 0, F.col("_change")).otherwise(0.0))
    return rows.join(changes, ["r", "c"], "left").withColumn("delta", delta).withColumn("scenario", F.col("lst") + F.col("delta")).drop("_change")


def quality(scored: DataFrame, target: str = "lst") -> dict[str, float]:
    """r2 and rmse of prediction by part, as r2_train, rmse_train, r2_test and rmse_test."""
    t, p = F.col(target), F.col("prediction")
    found = scored.groupBy("part").agg(F.var_pop(t).alias("v"), F.avg((t - p) * (t - p)).alias("mse")).collect()
    out = {}
    for row in found:
        out[f"r2_{row.part}"] = 1 - row.mse / row.v if row.v else float("nan")
        out[f"rmse_{row.part}"] = row.mse**0.5
    return out
