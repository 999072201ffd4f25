"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, fresh, given_back, join_counted, text_or_empty
from .minhash import word_hashes

#: Labelled rows that fit the document classifier, those of the smallest seeded hashes.
SAMPLE = 20_000
SEED = 8
#: A document is kept if the probability that it is good reaches this.
THRESHOLD = 0.5
#: Bytes of texts whose words and byte runs are hashed at a time.
PORTION = 1 << 19
#: Labelled rows that the fit takes up at a time.
BLOCK = 1024
#: Words of a window in which distinct words are counted.
WINDOW = 50
FEATURES = ("symbols", "capitals", "shouts", "digits", "word_length", "distinct", "least_distinct", "repeated_lines", "log_words", "short_text", "dull", "marks")
#: Hashed evidence: cells, a power of two, for words and pairs of words, and for runs of GRAM bytes; WEIGHT scales their unit vectors.
CELLS, GRAM, WEIGHT = 256, 4, 3.0
_WORD_MIX = np.uint64(0xD6E8FEB86659FD93)
_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
_DIGITS = bytes(set(range(256)) - set(range(48, 58)))


def features(text: bytes) -> list[float]:
    """FEATURES of a UTF-8 text; all zero but short_text for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 9 + [1.0, 0.0, 0.0]
    size = sum(map(len, words))
    windows = [len(set(part)) / len(part) for i in range(0, n, WINDOW) if len(part := words[i : i + WINDOW]) >= WINDOW // 2 or n < WINDOW // 2]
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = size - len(b"".join(words).translate(None, b"#*$%&|<>"))
    capitals, digits = len(text.translate(None, _CAPITALS)), len(text.translate(None, _DIGITS))
    mean, least = sum(windows) / len(windows), min(windows)
    return [
        min(3.0, symbols / n), capitals / size, min(2.0, text.count(b"!") / n), digits / size, min(20.0, size / n), mean, least,
        1 - len(set(lines)) / max(1, len(lines)), math.log(n), float(n < 20), float(mean < 0.5), float(symbols > 0.2 * n),
    ]


def _unit(cells: np.ndarray) -> np.ndarray:
    """Square roots of counts by row, scaled to length WEIGHT; empty rows stay 0."""
    roots = np.sqrt(cells)
    return WEIGHT * roots / np.maximum(np.sqrt(cells.sum(axis=1, keepdims=True)), 1.0)


def hashed(texts: list[bytes]) -> np.ndarray:
    """2 * CELLS numbers for each text: which words and pairs of words, and which runs of GRAM bytes it has, A-Z lower-cased."""
    out = np.zeros((len(texts), 2, CELLS))
    for first, part in _portions(texts):
        low = [x.lower() for x in part]
        words, owner = word_hashes(low)
        if len(words):
            pairs = words[:-1] * _WORD_MIX + words[1:]
            same = owner[1:] == owner[:-1]
            for values, of in ((words, owner), (pairs[same], owner[:-1][same])):
                cell = ((values ^ (values >> np.uint64(29))) * _WORD_MIX >> np.uint64(40) & np.uint64(CELLS - 1)).astype(np.int64)
                out[first : first + len(part), 0] += np.bincount(of * CELLS + cell, minlength=len(part) * CELLS).reshape(-1, CELLS)
        data = np.frombuffer(b"".join(low), np.uint8).astype(np.uint32)
        if len(data) >= GRAM:
            runs = data[: len(data) - GRAM + 1].copy()
            for i in range(1, GRAM):
                runs = (runs << np.uint32(8)) | data[i : len(data) - GRAM + 1 + i]
            sizes = np.array([len(x) for x in low])
            of = np.repeat(np.arange(len(low)), sizes)
            cell = ((runs * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(CELLS - 1)) + (of[: len(runs)] * CELLS)
            whole = of[: len(runs)] == of[GRAM - 1 :]
            out[first : first + len(part), 1] += np.bincount(cell[whole], minlength=len(part) * CELLS).reshape(-1, CELLS)
    return np.concatenate([_unit(out[:, 0]), _unit(out[:, 1])], axis=1)


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in order, some PORTION bytes at a time, or one text if it is longer."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PORTION):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def vectors(texts: list[bytes]) -> np.ndarray:
    """FEATURES, then hashed evidence, a row for each UTF-8 text."""
    return np.concatenate([np.array([features(x) for x in texts]).reshape(-1, len(FEATURES)), hashed(texts)], axis=1)


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = vectors([t.as_py() for t in part.column(2)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])


def fit(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 30, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression by Newton's method, over rows given in blocks.

    FEATURES are scaled, hashed evidence is as it is. A block alone is widened at a time, which bounds the memory.
    """
    n, m, rows = len(FEATURES), x[0].shape[1], sum(map(len, y))
    centre = sum(b.sum(axis=0, dtype=np.float64) for b in x) / rows
    scale = np.ones(m)
    scale[:n] = np.sqrt(sum(((b[:, :n] - centre[:n]) ** 2).sum(axis=0) for b in x) / rows) + 1e-9
    ridge = np.append(np.full(m, penalty), 1e-6)
    w = np.zeros(m + 1)
    for _ in range(rounds):
        slope, curve = -ridge * w, np.diag(ridge)
        for part, quality in zip(x, y, strict=True):
            z = np.column_stack([(part - centre) / scale, np.ones(len(part))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (quality - p)
            curve += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ centre)


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [p for b in batches for p in (b.slice(at, BLOCK) for at in range(0, b.num_rows, BLOCK))]
    x = [p.column(0).flatten().to_numpy().reshape(p.num_rows, -1) for p in parts]
    y = [p.column(1).to_numpy() for p in parts]
    if 0 < sum(q.sum() for q in y) < sum(map(len, y)):
        weights, bias = fit(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([bias], pa.float64())], ["weights", "bias"])


def evidence_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float]:
    """Weights over vectors and intercept, fitted by one task on the labelled documents of the smallest seeded hashes.

    Labels of doc_ids that documents lack don't count; a doc_id counts once, with its highest label and the text of the least hash. Only ids are
    ranked and at most `sample` of them broadcast, so the texts of the sample alone move. Zeros without both classes.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    chosen = cut(chosen.select("doc_id", (F.col("quality") > 0).cast("double").alias("quality")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "quality", "text")).alias("t")).select("doc_id", "t.quality", "t.text")
    measured = once.mapInArrow(given_back(_measured), "doc_id long, quality double, x array<float>")
    row = measured.repartition(1).select("x", "quality").mapInArrow(given_back(_fitted), "weights array<double>, bias double").first()
    return (row.weights, row.bias) if row else ([0.0] * (len(FEATURES) + 2 * CELLS), 0.0)


def with_evidence(docs: DataFrame, text: str, name: str, weights: list[float], bias: float) -> DataFrame:
    """docs with the log odds of a text column, from -12 to 12, under a new name; rows pass through a batch at a time."""
    w, at = np.array(weights), docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                # summed row by row, so that equal texts give equal odds wherever they stand
                odds = (vectors([(x.as_py() or "").encode() for x in part.column(at)]) * w).sum(axis=1) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(odds, -12.0, 12.0), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(given_back(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _placed(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with no_host, host, no_path, path under the given names: the site of a row is its source, its path its language there."""
    source, lang = F.col("source").cast("string"), F.col("lang").cast("string")
    return docs.withColumns(dict(zip(names, (source.isNull(), F.coalesce(source, F.lit("")), lang.isNull(), F.coalesce(lang, F.lit(""))), strict=True)))


SITE = ["no_host", "host", "no_path", "path"]


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(SITE, site_prior, n) of every site of rows(SITE, evidence), and the mean probability of all rows.

    A host's mean probability is shrunk toward the mean of all, a path's toward its host's shrunk one, each by a number of
    prior rows that the spread of the means beyond chance gives.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = cut(rows.groupBy(*SITE).agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    whole = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    whole = min(max(whole if whole is not None else 0.5, 1e-4), 1 - 1e-4)
    hosts = cut(paths.groupBy(*SITE[:2]).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    strength = _strength(hosts, F.col("hn"), F.col("hs"), F.lit(whole), whole)
    hosts = hosts.withColumn("host_mean", (F.col("hs") + strength * whole) / (F.col("hn") + strength))
    inside = cut(paths.join(hosts, SITE[:2]).select(*SITE, "n", "s", "host_mean"))
    inner = _strength(inside, F.col("n"), F.col("s"), F.col("host_mean"), whole)
    return cut(inside.select(*SITE, ((F.col("s") + inner * F.col("host_mean")) / (F.col("n") + inner)).alias("site_prior"), "n")), whole


def _strength(sites: DataFrame, n: Column, s: Column, mean: Column, whole: float) -> float:
    """Prior rows that a site's mean is shrunk by: the method of moments for a beta distribution of site means around `mean`.

    The variance of site means beyond what sites of their sizes show by chance gives the strength; between 2 and 10,000.
    """
    row = sites.agg(F.sum(n * (s / n - mean) ** 2), F.sum(n), F.count("*")).first()
    if not row[1] or row[2] < 2:
        return 10_000.0
    within = whole * (1 - whole)
    between = (row[0] - (row[2] - 1) * within) / row[1]
    return min(10_000.0, max(2.0, within / between - 1)) if between > 0 else 10_000.0


def _probability(evidence: str, prior: str, whole: float) -> Column:
    """The probability after a document's evidence is moved by the log odds of its site over those of all."""
    shift = _logit(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(prior)))) - math.log(whole / (1 - whole))
    return 1 / (1 + F.exp(-(F.col(evidence) + shift)))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, evidence, site_prior, score, kept) of every row of documents(doc_id, text, lang, source).

    evidence is the log odds of a logistic classifier over FEATURES and hashed words, word pairs and byte runs, fitted by one
    task on at most `sample` documents of labels(doc_id, quality), those of the smallest seeded hashes. Hosts (sources) and paths (languages
    within a host) then get posteriors by site_posteriors; site_prior is the path's, and score the probability after the document's evidence
    is moved by the log odds of its site over those of all. kept is score >= THRESHOLD.

    Null texts count as empty; null hosts and paths are sites of their own. Repeated rows each get a row. Without labels of
    both classes the evidence is 0 and every row is kept. An empty table gives none. Other columns are not read.
    Sites are summed with map-side combination; their table is broadcast where it is small, else only its hot sites are.
    """
    weights, bias = evidence_model(docs, labels, sample)
    placed = _placed(docs.select("doc_id", "text", "source", "lang"), SITE).select(F.col("doc_id").cast("long").alias("doc_id"), *SITE, "text")
    rows = cut(with_evidence(placed, "text", "evidence", weights, bias).drop("text"))
    sites, whole = site_posteriors(rows)
    scored = join_counted(rows, sites, SITE, "n").select("doc_id", "evidence", "site_prior", _probability("evidence", "site_prior", whole).alias("score"))
    return scored.withColumn("kept", F.col("score") >= THRESHOLD if any(weights) else F.lit(True))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents without the rows whose score is below THRESHOLD; all columns stay, whatever their names.

    Every row is judged by its own text, source and language, so neither rows that share its doc_id nor a null doc_id change its verdict, and
    repeated rows all stay or all go. Null and empty texts are judged like any other; null sources and languages are sites of their own.
    Without labels of both classes all rows stay; an empty table gives an empty one. Texts are measured a second time rather than
    shuffled: nothing but counts of sites moves.
    """
    weights, bias = evidence_model(docs, labels, sample)
    if not any(weights):
        return docs
    names = fresh(docs, *SITE, "evidence", "site_prior", "n")
    rows = with_evidence(_placed(docs, names[:4]), "text", names[4], weights, bias)
    # the sums of sites take the text and the site alone through the worker
    sites, whole = site_posteriors(with_evidence(_placed(docs.select("text", "source", "lang"), SITE).select(*SITE, "text"), "text", "evidence", weights, bias).drop("text"))
    renamed = sites.select(*(F.col(x).alias(y) for x, y in zip([*SITE, "site_prior", "n"], [*names[:4], *names[5:]], strict=True)))
    placed = join_counted(rows, renamed, names[:4], names[6])
    return placed.where(_probability(names[4], names[5], whole) >= THRESHOLD).select(*docs.columns)
