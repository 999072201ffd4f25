"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that end a word: space and \x09 to \x0D.
BREAKS = " \t\n\x0b\f\r"
WORD = r"[^ \x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set where a local session names none, and elsewhere one must be named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rastrel-"))
    return context._jsc.sc().getCheckpointDir().get()


def given_back(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker process, which stays for other tasks, gives freed memory back to the system."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        settle()

    return whole


def settle() -> None:
    """Gives memory that Arrow and the allocator hold free back to the system, where the system can take it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that later steps neither recompute it nor depend on an executor.

    What went before is then collected: Spark deletes the files of a shuffle, and of a checkpoint where its cleaner is set to, only
    once the driver's collector finds that nothing refers to them, so those of many short rounds would pile up on disk.
    """
    spark = df.sparkSession
    shared_folder(spark)
    df = df.checkpoint(eager=True)
    gc.collect()
    spark._jvm.System.gc()
    return df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df does not have, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


#: Keys of more than one part in MOST_HOT of all rows are broadcast: there are fewer than MOST_HOT of them.
MOST_HOT = 10_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows left-joined with table on keys, null-safely; table has one row a key and counts the rows of its key in column n, which goes.

    A table of MOST_HOT rows or fewer is broadcast whole. Of a larger one the keys with more than one part in MOST_HOT of
    all rows, which are fewer than MOST_HOT, are broadcast, and their rows are spread by a salt over the join of the rest,
    so neither a broadcast nor a task of the join grows with a hot key. The table's other columns must be new to rows.
    """
    size, total = table.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    names = [c for c in table.columns if c not in keys and c != n]
    other = fresh(rows, *(f"{k}__" for k in keys))
    renamed = table.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), *names, n)
    equal = lambda: reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)))
    if size <= MOST_HOT:
        return rows.join(F.broadcast(renamed.drop(n)), equal(), "left").drop(*other)
    limit = max(1, total // MOST_HOT)
    salt, hit, spread = fresh(rows, "salt__", "hit__", "spread__")
    hot = [f"{x}__h" for x in names]
    heavy = renamed.where(F.col(n) > limit).select(*other, *(F.col(x).alias(h) for x, h in zip(names, hot, strict=True)), F.lit(True).alias(hit))
    met = rows.join(F.broadcast(heavy), equal(), "left").drop(*other)
    met = met.withColumn(salt, F.when(F.col(hit), 1 + F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(100_000))).otherwise(0).cast("int"))
    met = met.join(renamed.drop(n).withColumn(spread, F.lit(0)), equal() & (F.col(salt) == F.col(spread)), "left")
    return met.select(*rows.columns, *(F.when(F.col(hit), F.col(h)).otherwise(F.col(x)).alias(x) for x, h in zip(names, hot, strict=True)))
