"""Geographic inputs derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PIXEL = 30.0
TABLES = ("events", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "embeddings", "nation")

VIEWS = {
    "pixels": """SELECT r, c, 8000 + 5 * c + 2 * r AS b2, 9000 + 8 * r AS b4, 12000 + 12 * c - 3 * r AS b5, 11000 + 10 * r + 2 * c AS b6,
        10000 + 6 * c + r AS b7, 43000 + 12 * r + 5 * c + v AS st, qa FROM (SELECT CAST(floor(event_id / 100.0) AS INT) AS r, CAST(event_id % 100 AS INT) AS c,
        CAST(floor(value) AS INT) AS v, CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 128 ELSE 0 END AS qa FROM events) p""",
    "buildings": """SELECT id, x0, y0, x0 + side AS x1, y0 + side AS y1, side * side AS area_m2, material, slope, seg FROM (SELECT c_custkey AS id,
        CAST((c_custkey * 37) % 2900 AS DOUBLE) AS x0, CAST((c_custkey * 53) % 2900 AS DOUBLE) AS y0, CAST(20 + (c_custkey % 5) * 15 AS DOUBLE) AS side,
        lower(c_mktsegment) AS material, abs(c_acctbal) - 45 * floor(abs(c_acctbal) / 45) AS slope, c_mktsegment AS seg FROM customer) b""",
    "roofs": """SELECT s_suppkey AS id, CAST((s_suppkey * 211) % 2800 AS DOUBLE) AS x0, CAST((s_suppkey * 97) % 2800 AS DOUBLE) AS y0,
        CAST((s_suppkey * 211) % 2800 + 60 AS DOUBLE) AS x1, CAST((s_suppkey * 97) % 2800 + 45 AS DOUBLE) AS y1 FROM supplier""",
    "class_px": "SELECT l_orderkey AS chip, CAST(l_partkey % 5 AS INT) AS k, CAST(sum(l_quantity) AS BIGINT) AS px FROM lineitem GROUP BY l_orderkey, CAST(l_partkey % 5 AS INT)",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame; column pruning reaches its scan."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables and the views that it names; no other table's files are opened."""
    text = with_views(sql)
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """sql with the views that it names as common table expressions."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in sql]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ", ".join(used + [body[len(start) :]])
    return ("WITH " + ", ".join(used) + " " if used else "") + body
