"""Shards that all hold the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_or_empty

SEED = 77
SHARDS = 8
#: Cells of a source's seeded order, and of the order of all rows, as a power of two; each is ranked by itself. There are enough for
#: cells of CELL_ROWS rows, and 2**LEAST_BITS at least.
LEAST_BITS, CELL_ROWS = 12, 250_000


def cell_bits(rows: int) -> int:
    """Bits of the number of cells for so many rows."""
    return max(LEAST_BITS, (rows // CELL_ROWS).bit_length())


def _ranked(rows: DataFrame, keys: list[str], cell: str, order: list[str]) -> DataFrame:
    """rows with rank (from 1, by cell and then order, within keys) and total (rows of the keys).

    Cells are counted first, which the map side combines, and their running sums joined back; only a cell's rows are sorted
    together, so a source with a third of all rows is ranked by as many tasks as it has cells.
    """
    counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    before = F.sum("n").over(by.orderBy(cell)) - F.col("n")
    counts = cut(counts.select(*keys, cell, before.alias("before"), F.sum("n").over(by).alias("total")))
    within = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return rows.join(counts, [*keys, cell]).withColumn("rank", F.col("before") + within).drop("before")


def interleave(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of documents(doc_id, text, source).

    Rows are shuffled by a seeded hash within their source and ranked; their fractional ranks, (rank - 1/2) / rows of the
    source, are sorted over all sources, and the order is cut into shards whose row counts differ by one at most (law
    `rows`). Every stretch of that order holds the sources in proportion, and so does every shard. slot is the place in
    the shard.

    size is the UTF-8 bytes of the text plus one. Null texts have no bytes; a null source is a source. Ties go by doc_id, then
    by the text's hash; rows equal in all of them are interchangeable. An empty table gives none; other columns are not
    read. Only numbers and the source are shuffled, never a text.
    """
    text = text_or_empty()
    mark = F.xxhash64(F.lit(SEED), "doc_id", text)
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            mark.alias("mark"),
        )
    )
    bits = cell_bits(rows.count())
    rows = rows.withColumn("cell", F.shiftright("mark", 64 - bits).cast("int"))
    ranked = _ranked(rows, ["no_source", "source"], "cell", ["mark", "doc_id", "text_crc32", "size"])
    share = (F.col("rank") - 0.5) / F.col("total")
    ranked = ranked.select("doc_id", "size", "text_crc32", "no_source", "source", "mark", share.alias("share"), F.lit(1).alias("one"), F.floor(share * (1 << bits)).cast("int").alias("cell"))
    ranked = _ranked(cut(ranked), ["one"], "cell", ["share", "no_source", "source", "mark", "doc_id", "text_crc32", "size"])
    place, total = F.col("rank") - 1, F.col("total")
    shard = F.expr(f"(rank - 1) * {shards} div total")
    start = F.expr(f"(((rank - 1) * {shards} div total) * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
