"""Operators on feature tables: filters, matches by id, groups, numbering and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut


# filters
def minimum_area(features: DataFrame, least: float, area: str = "area_m2") -> DataFrame:
    """Features whose area is known and at least `least`."""
    return features.where(F.col(area) >= least)


def changed(features: DataFrame, delta: str, at_most: float = -0.01) -> DataFrame:
    """Features whose change is below `at_most`."""
    return features.where(F.col(delta) < at_most)


def known(features: DataFrame, field: str, keep_null: bool = False) -> DataFrame:
    """Features whose field is not null, or all."""
    return features if keep_null else features.where(F.col(field).isNotNull())


def clipped(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """boxes(x0, y0, x1, y1, ...) that share area with a frame, cut to it."""
    inside = boxes.where((F.col("x1") > x0) & (F.col("x0") < x1) & (F.col("y1") > y0) & (F.col("y0") < y1))
    low, high = {"x0": x0, "y0": y0}, {"x1": x1, "y1": y1}
    return inside.withColumns({k: F.greatest(k, F.lit(float(v))) for k, v in low.items()} | {k: F.least(k, F.lit(float(v))) for k, v in high.items()})


# matches by id
def _id(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def with_ids(features: DataFrame, ids: DataFrame, field: str, id_field: str) -> DataFrame:
    """Features whose id stands in ids, both trimmed; a null id matches nothing."""
    return features.join(ids.select(_id(id_field).alias("_id")).distinct(), _id(field) == F.col("_id"), "left_semi")


def unfound(wanted: DataFrame, features: DataFrame, field: str, id_field: str) -> DataFrame:
    """(missing): how many rows of wanted(field) have an id that no feature has."""
    return wanted.join(features.select(_id(id_field).alias("_id")).distinct(), _id(field) == F.col("_id"), "left_anti").agg(F.count("*").alias("missing"))


def first_match(left: DataFrame, key: str, *found: tuple[DataFrame, str]) -> DataFrame:
    """left with match_id: that of the first table of found, each (key, its column of matches), that has one for the row's key."""
    out, names = left, []
    for i, (table, column) in enumerate(found):
        names.append(f"_m{i}")
        out = out.join(table.select(F.col(key).alias(f"_k{i}"), F.col(column).alias(f"_m{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out.withColumn("match_id", F.coalesce(*names)).drop(*names)


# keys
def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order; null keys are a key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicates(rows: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """All rows whose key comes more than once, with how often, sorted by key; the counts are made before rows meet them."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)
    return rows.join(counts, keys).orderBy(*keys)


def numbered(rows: DataFrame, *order: Column | str, name: str = "number", start: int = 1) -> DataFrame:
    """rows with consecutive numbers in an order without ties: ranges are ranked by themselves, and their counts alone come together."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + rank + (start - 1)).drop("_part", "_before")


def head(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order, all for 0; after a deduplication this is its limit."""
    return rows.orderBy(*order).limit(n) if n else rows.orderBy(*order)


def oversampled(rows: DataFrame, key: str, order: str, name: str = "copies") -> DataFrame:
    """rows with how often each comes until every class has as many as the largest: whole rounds, and one more for the first of its class."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_most", F.max("_n").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.join(F.broadcast(counts), key).withColumn(name, 1 + F.floor((F.col("_most") - 1 - place) / F.col("_n"))).drop("_n", "_most")


# reports
def group_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std, least, most) of a value by group, null keys left out, by ascending mean; std is that of a sample."""
    v = F.col(value)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")).orderBy("mean", key)


def group_means(rows: DataFrame, key: str, value: str, only: list[str] | None = None) -> DataFrame:
    """(key, mean) of a value by group, of the listed groups or of all, by ascending mean."""
    rows = rows.where(F.col(key).isin(only)) if only else rows.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).orderBy("mean", key)


def weighted_summary(rows: DataFrame, value: str, weight: str, chosen: Column) -> DataFrame:
    """(mean, weighted, most, selected_mean) of a value over all rows and over the chosen ones, in one aggregation."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.agg(F.avg(v).alias("mean"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted"), F.max(v).alias("most"), F.avg(F.when(chosen, v)).alias("selected_mean"))


def change_report(rows: DataFrame, delta: str, weight: str) -> DataFrame:
    """(n, mean_cooling, weighted_cooling, most, least) of changes, whose sign turns."""
    d, w = F.col(delta), F.when(F.col(delta).isNotNull(), F.col(weight))
    return rows.agg(F.count("*").alias("n"), (-F.avg(d)).alias("mean_cooling"), (-F.try_divide(F.sum(d * w), F.sum(w))).alias("weighted_cooling"), F.max(-d).alias("most"), F.min(-d).alias("least"))


def anomalies(rows: DataFrame, value: str, name: str = "anomaly") -> DataFrame:
    """rows with the difference of a value to the mean of all, which is one number."""
    mean = rows.agg(F.avg(value).alias("_mean"))
    return rows.join(F.broadcast(mean)).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def counters(rows: DataFrame, **tests: Column) -> DataFrame:
    """One row: total, and how many rows pass each test."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(t).alias(n) for n, t in tests.items()))


def extent(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """(x0, y0, x1, y1) around all boxes, with a margin."""
    return boxes.agg(*((F.min(k) - margin).alias(k) for k in ("x0", "y0")), *((F.max(k) + margin).alias(k) for k in ("x1", "y1")))


def concatenated(*layers: tuple[DataFrame, str], kind: str = "kind") -> DataFrame:
    """All rows of layers, each (table, its kind), with the columns of any; null where a layer lacks one."""
    out = None
    for table, name in layers:
        table = table.select("*", F.lit(name).alias(kind))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out
