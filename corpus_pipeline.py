"""A training-data pipeline: each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import byte_bpe, mixing, quality, queries, secrets, simhash
from rastrel.llm.common import documents, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each judged by its own text, source and language, whatever its doc_id; see kept_documents for
    nulls, empty texts, repeated rows and empty tables."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, whose fingerprints link at 3 bits or fewer, or are up to 9 bits apart with 5-word shingles verified to be 0.8 alike.

    The smallest (doc_id, fingerprint, text hash) stays; rows without a doc_id all stay; see one_of_each for ties, repeated rows and empty texts."""
    return simhash.one_of_each(docs, wide=True)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their secrets replaced by the kind of secret; n_chars follows the new text, null for a null text. No row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources takes them; rows without words are never taken; see mixed for ties, nulls and repeated rows."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids of every row that is left, and of what they decode to; null texts count as empty."""
    return byte_bpe.round_trip(docs, queries.tokenizer_file(queries.BYTE_RANKS), queries.byte_pattern())


STAGES = [("quality classifier", keep_good), ("simhash near-dedup", keep_distinct), ("secret scan", hide_secrets), ("source mixing", mix_sources), ("byte-level bpe", encode)]

#: No stage has results that DuckDB could make: they rest on a fitted model, XXH64, zstandard, Spark's hashes and BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn, each result written as Parquet in the shared folder and read again.

    A stage's files go when the next one's are written; the last one's stay for the reader. Outside a local session
    spark.checkpoint.dir must name the folder.
    """
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}")
        docs = spark.read.parquet(path)
        if number:
            _remove(spark, f"{folder}/{number - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
