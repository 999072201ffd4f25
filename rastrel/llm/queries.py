"""Queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, minhash, mixing, quality, rules, secrets, sharding, simhash, suffixes, token_counts
from .common import documents

#: Files of public tokenizers, by the package that finds them.
PIECE_MODEL, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pattern that splits text before the merges of the rank file."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints link at 3 or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text."""
    return minhash.successor_fingerprints(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, their hash, and all spans."""
    return secrets.scan(documents(spark, sf_dir))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document shares with a smaller one in strings of 50."""
    return suffixes.repeated_strings(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file(PIECE_MODEL))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a weighted mixture takes of every document."""
    return mixing.mix(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every document's ids and of what they decode to."""
    return byte_bpe.round_trip(documents(spark, sf_dir), tokenizer_file(BYTE_RANKS), byte_pattern())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document given its text, host and path."""
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of quality rules of every document, with the verdict of the current policy."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "failures", "base_failed", "kept"]
    return rules.judged(documents(spark, sf_dir)).select(*(F.col(x) for x in names))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the current policy: rows that fail it, that fail it alone, and that are kept without it."""
    return rules.ablations(rules.ledger(documents(spark, sf_dir))).drop("seen")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.interleave(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this subpackage."""
    return {f.__name__: f for f in (op1_simhash, op2_minhash, op3_secrets, op4_suffixes, op5_token_counts, op6_mixing, op7_byte_bpe, op8_quality, op9_rules, op10_sharding, rule_ablations)}


def _rules_sql() -> str:
    failures = " + ".join(f"CASE WHEN {rule} THEN {rules.BITS[name]} ELSE 0 END" for name, rule in rules.RULES.items())
    base, policy = rules.POLICIES["base"], rules.POLICIES[rules.POLICY]
    return rf"""
    WITH w AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
        FROM documents),
    tok AS (SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
    tri AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
    cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
    m AS (
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
               CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
    f AS (SELECT *, CAST({failures} AS INTEGER) AS failures FROM m)
    SELECT *, failures & {base} <> 0 AS base_failed, failures & {base | policy} = 0 AS kept FROM f
    """


def _ablations_sql() -> str:
    mask = rules.POLICIES[rules.POLICY]
    listed = ", ".join(f"('{name}', {bit})" for name, bit in rules.BITS.items() if bit & mask)
    return f"""
    WITH f AS ({_rules_sql()}), r AS (SELECT * FROM (VALUES {listed}) t(rule, bit))
    SELECT rule, CAST(bit AS INTEGER) AS bit, count(*) FILTER (WHERE failures & bit <> 0) AS n_failed,
           count(*) FILTER (WHERE failures & {mask} = bit) AS n_failed_alone, count(*) FILTER (WHERE failures & {mask} IN (0, bit)) AS n_kept_without
    FROM f CROSS JOIN r GROUP BY rule, bit
    """


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op9_rules": _rules_sql(), "rule_ablations": _ablations_sql()}
