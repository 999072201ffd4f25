"""MinHash fingerprints of documents: universal hash permutations over word shingles, bands joined in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, text_or_empty

SHINGLE = 5
PERMUTATIONS = 128
#: 25 bands of 5 values find a pair of similarity 0.8 with probability 1 - (1 - 0.8**5)**25 > 0.9999.
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Bytes of text whose shingles are permuted at a time, and of one text before it is taken piecewise.
CHUNK, PIECE = 1 << 18, 1 << 20
#: Members of one band bucket that a task compares at once.
BUCKET = 1024

_rng = np.random.default_rng(2024)
_A = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ORDER = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 2**64)) for i in range(SHINGLE)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size, inverse = max(n, 2 * CHUNK), pow(_BASE, -1, 2**64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, inverse)]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each word's text.

    A word's hash is its slice of a running polynomial, moved to the origin.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    first = np.cumsum([1, *(len(x) + 1 for x in texts)])
    inner = ~_SPACE[data]
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(data) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    words = (run[ends] - run[starts]) * inverse[starts]
    words = (words ^ (words >> np.uint64(31))) * _MIX
    words ^= words >> np.uint64(29)
    return words, np.searchsorted(first, starts, side="right") - 1


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and each hash's text. A text of one to four words is one shingle; none of none.

    Equal word sequences get equal hashes whatever white space stands between the words.
    """
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    count = np.bincount(owner, minlength=len(texts))
    n = len(words)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    of = np.concatenate([owner, np.full(SHINGLE, -1)])
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += np.where(of[i : i + n] == owner, padded[i : i + n], np.uint64(0)) * _ORDER[i]
    begins = np.concatenate([[True], owner[1:] != owner[:-1]])
    keep = (of[SHINGLE - 1 : SHINGLE - 1 + n] == owner) | (begins & (count[owner] < SHINGLE))
    total, owner = total[keep], owner[keep]
    total = (total ^ (total >> np.uint64(30))) * _MIX
    return total ^ (total >> np.uint64(27)), owner


def _pieces(text: bytes) -> list[bytes]:
    """Pieces of whole words of a text that is longer than PIECE, each repeating the last four words of the one before."""
    if len(text) <= PIECE:
        return [text]
    words, out, at = text.split(), [], 0
    while True:
        size, to = 0, at
        while to < len(words) and (size < PIECE or to - at < SHINGLE):
            size += len(words[to]) + 1
            to += 1
        out.append(b" ".join(words[at:to]))
        if to >= len(words):
            return out
        at = to - SHINGLE + 1


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row of PERMUTATIONS minima (16 low bits) for each UTF-8 text; all ones for a text without words."""
    parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
    out = np.full((len(texts), PERMUTATIONS), 2**32 - 1, np.uint64)
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to][1]) <= CHUNK):
            size += len(parts[to][1])
            to += 1
        hashes, owner = shingle_hashes([p for _, p in parts[at:to]])
        if len(hashes):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = np.array([i for i, _ in parts[at:to]])[owner[starts]]
            least = np.empty((len(starts), PERMUTATIONS), np.uint64)
            for k in range(PERMUTATIONS):
                least[:, k] = np.minimum.reduceat((hashes * _A[k] + _B[k]) >> np.uint64(32), starts)
            np.minimum.at(out, rows, least)
        at = to
    return (out & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row: the estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by as many of the following text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _compared(pending: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    changed = [edited(t, f).encode() for _, t, f in pending]
    own, new, after = (signatures(x) for x in ([t.encode() for _, t, _ in pending], changed, [f.encode() for _, _, f in pending[-1:]]))
    # a row's following text is the next row's own, but at the end of a run; those are signed apart
    ends = [i for i in range(len(pending) - 1) if pending[i][2] is not pending[i + 1][1]]
    nexts = np.concatenate([own[1:], after])
    if ends:
        nexts[ends] = signatures([pending[i][2].encode() for i in ends])
    columns = [[i for i, _, _ in pending], [len(t) for _, t, _ in pending], [hashlib.sha256(x).hexdigest() for x in changed], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in new], likeness(own, new), likeness(own, nexts)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)], _NAMES)


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, each bucket's guard last: every row but a guard is compared with the row after it."""
    last, pending, size = None, [], 0
    for batch in batches:
        for bucket, guard, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if last is not None and last[0] == bucket and not last[1]:
                pending.append((last[2], last[3], text))
                size += len(text)
            if size > 4 * PIECE:
                yield _compared(pending)
                pending, size = [], 0
            if last is None or last[0] != bucket or not last[1]:
                last = (bucket, guard, doc, text)
    if pending:
        yield _compared(pending)


def _partition_firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = [int(x) for b in batches if b.num_rows for x in [b.column(0).to_numpy(zero_copy_only=False).min()]]
    if least:
        yield pa.RecordBatch.from_arrays([pa.array([min(least)], pa.int64())], ["first"])


def successor_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, for every row of documents(doc_id, text).

    The document after a row is the next by (doc_id, text), null doc_id first, and after the last the first; a lone
    document follows itself. Null texts count as empty; the likeness of two texts without words is 1. Repeated rows
    each get a result, an empty table gives none, other columns are not read.

    Order needs no global sort on one task: a first job range-partitions the ids and returns one smallest id for each
    partition (as many as shuffle partitions). These bound the buckets; the texts then move once, to their bucket, and
    the first row of each bucket goes to the bucket before as well, as the guard that ends it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"))
    wide = partitions(spark)
    firsts = sorted({r[0] for r in rows.select("at").repartitionByRange(wide, "at").mapInArrow(_partition_firsts, "first long").collect()})
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    bounds = np.array(firsts, np.int64)

    @F.arrow_udf("int")
    def bucket_of(at: pa.Array) -> pa.Array:
        return pa.array((np.searchsorted(bounds, at.to_numpy(zero_copy_only=False), side="right") - 1).astype(np.int32))

    placed = rows.withColumn("bucket", bucket_of("at"))
    is_first = F.col("at").isin(firsts)
    before = F.pmod(F.col("bucket") - 1, F.lit(len(firsts)))
    spots = F.when(is_first, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")), F.struct(before.alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g"))))
    dealt = placed.withColumn("spot", F.explode(spots)).select(F.col("spot.b").alias("bucket"), F.col("spot.g").alias("guard"), "doc_id", "text", "at")
    dealt = dealt.repartitionById(len(firsts), F.col("bucket")).sortWithinPartitions("bucket", "guard", "at", "text")
    return dealt.select("bucket", "guard", "doc_id", "text").mapInArrow(_in_order, SCHEMA)


def _rows_of_bands(similarity: float) -> int:
    """The most values a band may have, ROWS at most, for the bands to miss a pair of that similarity with probability below 1e-4."""
    for rows in range(ROWS, 0, -1):
        if (1 - similarity**rows) ** (PERMUTATIONS // rows) < 1e-4:
            return rows
    raise ValueError(f"{PERMUTATIONS} permutations do not find pairs of similarity {similarity}")


def _signed_batches(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() for x in batch.column(1)]
        marks = signatures(texts)
        bands = [[int.from_bytes(hashlib.blake2b(row[k * rows : (k + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(PERMUTATIONS // rows)] for row in marks]
        hashes, owner = shingle_hashes(texts)
        sets = [np.unique(hashes[owner == i]).view(np.int64) for i in range(len(texts))] if texts else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in marks], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "signature", "bands", "shingles"])


def _candidates(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket whose signatures agree in `least` of their values or more."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            members = sorted({m["doc_id"]: m["signature"] for m in members}.items())
            marks = np.array([np.frombuffer(s, ">u2") for _, s in members])
            for i in range(len(members) - 1):
                for j in np.flatnonzero((marks[i + 1 :] == marks[i]).mean(axis=1) >= least).tolist():
                    a.append(members[i][0])
                    b.append(members[i + 1 + j][0])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicate_links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard): pairs of representatives whose 5-word shingle sets have the given Jaccard similarity or more.

    Equal shingle sets are first reduced to their smallest doc_id, so copies never become pairs; shingle_classes names the
    representative of every document, and so the links within a class and of its other members. Signature
    bands are joined in Spark; a bucket above BUCKET members is cut into chunks that meet two at a time. Candidates are
    verified on the shingle hashes. Below 0.8 the bands get shorter and the signatures may agree in less (0.2 below the
    similarity), which makes more candidates; a similarity that no bands find raises. Texts without words link to nothing; rows with a null doc_id are left out.
    """
    rows, least = _rows_of_bands(similarity), similarity - 0.2
    classes = cut(_classes(docs, rows))
    banded = classes.select("doc_id", "signature", F.posexplode("bands").alias("band", "key"))
    sizes = cut(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = banded.join(sizes, ["band", "key"]).withColumn("chunks", F.ceil(F.col("n") / BUCKET).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lists = met.groupBy("band", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")).agg(F.collect_list(F.struct("doc_id", "signature")).alias("members"))
    pairs = lists.select("members").mapInArrow(lambda batches: _candidates(batches, least), "a long, b long").distinct()
    left, right = (classes.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"{x}_shingles")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.select("a", "b", (shared / (F.size("a_shingles") + F.size("b_shingles") - shared)).alias("jaccard")).where(F.col("jaccard") >= similarity)


def shingle_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, sets) for every row with a doc_id: the representative that stands for it in near_duplicate_links.

    Rows of one class have equal shingle sets, whose hash is sets; class_id is their smallest doc_id. Texts without words are
    in no class: both are null.
    """
    marked = cut(_marked(docs).select("doc_id", F.when(F.size("shingles") > 0, _set_hash()).alias("sets")))
    least = marked.where("sets is not null").groupBy("sets").agg(F.min("doc_id").alias("class_id"))
    return marked.join(least, "sets", "left").select("doc_id", "class_id", "sets")


def _set_hash() -> Column:
    return F.sha2(F.col("shingles").cast("string"), 256)


def _marked(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return narrow.mapInArrow(lambda batches: _signed_batches(batches, rows), "doc_id long, signature binary, bands array<long>, shingles array<long>")


def _classes(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    kept = _marked(docs, rows).where("size(shingles) > 0").groupBy(_set_hash().alias("sets")).agg(F.min_by(F.struct("doc_id", "signature", "bands", "shingles"), "doc_id").alias("x"))
    return kept.select("sets", "x.*")
