"""SimHash near-duplicates, linked through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, given_back, join_counted, text_or_empty
from .components import connected_components
from .minhash import shingle_hashes

SEED = 42
SHINGLE = 3
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 3
#: Words of a text that are hashed at a time, which bounds a worker's memory for very long texts.
STRIDE = 65_536
#: The 64 bits are cut into BLOCKS runs; two linked fingerprints agree on BLOCKS - RADIUS runs at least.
BLOCKS = 6
#: Reference fingerprints of the distance tables.
PIVOTS = 24
#: Members of one bucket that a task compares at once; larger buckets are cut by cells of pivot distances.
BUCKET = 4096
#: Fingerprints farther than RADIUS and up to WIDE bits apart link if 5-word shingles of their texts are as similar as this.
#: They meet under masks of WIDE_AGREE of WIDE_BLOCKS runs, which show all pairs up to 5 bits and most beyond.
WIDE, SIMILARITY, WIDE_BLOCKS, WIDE_AGREE = 9, 0.8, 8, 3


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of the 3-word shingles of a UTF-8 text, A-Z lower-cased; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, total, STRIDE):
        part = words[at : at + STRIDE + SHINGLE - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], ["doc_id", "h", "fp"])


def _identity(docs: DataFrame) -> list[Column]:
    """doc_id and the hash of the text, which tell rows apart that differ in either."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of documents(doc_id, text); h is the text's hash, fp holds the 64 bits as a signed long. A null text counts as empty."""
    return docs.select(*_identity(docs), text_or_empty().cast("binary").alias("text")).mapInArrow(given_back(_fingerprints), "doc_id long, h long, fp long")


def pivots() -> np.ndarray:
    """Reference fingerprints: zero first (its distance is the weight), then fixed pseudo-random ones."""
    return np.concatenate([np.zeros(1, np.uint64), np.random.default_rng(SEED).integers(0, 2**64, PIVOTS - 1, np.uint64)])


def distances(marks: np.ndarray) -> np.ndarray:
    """The distance table of fingerprints: a row each, a column for each pivot."""
    return np.bitwise_count(marks[:, None] ^ pivots()[None, :]).astype(np.int8)


def survivors(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows of two distance tables no column tells apart by more than the radius."""
    return np.abs(a - b).max(axis=1) <= radius


def _masks(blocks: int, agree: int) -> list[int]:
    """One mask for each choice of `agree` of the runs that the 64 bits are cut into."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edge, edge[1:], strict=False)]
    return [sum(x) for x in combinations(runs, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(members: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place in members (unsigned longs, sorted by distance to the first pivot by this function) with those after it within the radius.

    The table holds each member's distances to the pivots. By the triangle inequality no two linked members differ by
    more than the radius in any column: members are sorted by the first column, each meets only those within the
    radius there, pairs with a larger difference in another column go, and the bits of the rest are compared.
    """
    table = distances(members)
    until = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(len(members) - 1):
        near = np.arange(i + 1, until[i])
        for columns in (slice(1, 5), slice(5, PIVOTS)):
            if len(near):
                near = near[survivors(table[near, columns], table[i : i + 1, columns], radius)]
        if len(near):
            near = near[np.bitwise_count(members[near] ^ members[i]) <= radius]
        if len(near):
            yield i, near


def in_pivot_order(members: np.ndarray) -> np.ndarray:
    """Distinct members by their distance to the first pivot."""
    members = np.unique(members)
    return members[np.argsort(np.bitwise_count(members ^ pivots()[0]), kind="stable")]


def spanning_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between members (unsigned longs) that join all that the radius joins among them, one fewer than members at most."""
    members = in_pivot_order(members)
    parent, links = list(range(len(members))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, near in near_pairs(members, radius):
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[b] = a
                links.append((int(members[i]), int(members[j])))
    return links


def _of_two(members: np.ndarray, radius: int) -> np.ndarray:
    """The rows of pairs of fingerprints that the distance table leaves and the bits confirm."""
    stay = members[survivors(distances(members[:, 0]), distances(members[:, 1]), radius)]
    return stay[np.bitwise_count(stay[:, 0] ^ stay[:, 1]) <= radius]


def _met(batches: Iterable[pa.RecordBatch], radius: int, larger) -> Iterator[pa.RecordBatch]:
    """Links of buckets of two, all at once, and of larger ones by `larger`, from a column of members."""
    for batch in batches:
        column = batch.column(0)
        starts, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().view(np.uint64)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        found = [_of_two(np.stack([values[two], values[two + 1]], axis=1), radius)]
        for at, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            found.append(np.array(larger(values[at : at + size], radius), np.uint64).reshape(-1, 2))
        ends = np.concatenate(found)
        ends = np.sort(ends, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _placed(distinct: DataFrame, radius: int, blocks: int, agree: int) -> DataFrame:
    """Rows of distinct(fp, ...) once for each bucket t, key, cell, i, j where fingerprints meet: under one mask, and in a large bucket in a cell of pivot distances too.

    A bucket of more than BUCKET members is cut into cells one wider than the radius over the distances to two pivots; no
    linked pair lies more than one cell apart in either, so each member stands in its own cell and the next ones, and
    any two that may link meet in a cell. Cells of a bucket that is larger still are cut into chunks by a hash, each
    two of which meet, so no task holds an unbounded bucket and none is capped.
    """
    masks = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_masks(blocks, agree))))
    keyed = distinct.select("*", F.explode(masks).alias("x")).select(*distinct.columns, "x.t", "x.key")
    sizes = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(sizes, ["t", "key"])
    far = [F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))))) / (radius + 1)).cast("int") for p in pivots()[1:3]]
    cells = F.array(*(F.struct((far[0] + x).alias("x"), (far[1] + y).alias("y")) for x in (0, 1) for y in (0, 1)))
    met = met.withColumn("cell", F.explode(F.when(F.col("n") > BUCKET, cells).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))))
    return _chunked(met, F.ceil(F.col("n") / (8 * BUCKET)).cast("int"))


def _chunked(met: DataFrame, chunks: Column) -> DataFrame:
    """Rows of a bucket dealt by the hash of fp to so many chunks, once for each two chunks i <= j that meet."""
    met = met.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")}).drop("chunks", "c", "o")


_PLACE = ("t", "key", "cell", "i", "j")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of distinct(fp) that connect exactly what Hamming distance RADIUS connects.

    Every fingerprint goes to one bucket for each mask of BLOCKS - RADIUS of BLOCKS runs, under its masked bits; any two
    within the radius meet in at least one, where the table of their pivot distances discards pairs and the bits of the rest are
    compared. Only a spanning forest of a bucket's links leaves the task, never all pairs.
    """
    lists = _placed(distinct, RADIUS, BLOCKS, BLOCKS - RADIUS).groupBy(*_PLACE).agg(F.collect_list("fp").alias("members"))
    return lists.where("size(members) > 1").select("members").mapInArrow(given_back(lambda x: _met(x, RADIUS, spanning_links)), "a long, b long").distinct()


def first_masks(apart: np.ndarray, blocks: int = WIDE_BLOCKS, agree: int = WIDE_AGREE) -> np.ndarray:
    """The place among _masks of the first mask under which fingerprints agree that differ in the bits `apart`; -1 if none."""
    places = np.full(1 << blocks, -1)
    for i, runs in enumerate(combinations(range(blocks), agree)):
        places[sum(1 << x for x in runs)] = i
    same = np.stack([apart & np.uint64(run) == 0 for run in _masks(blocks, 1)], axis=1)
    return places[(same & (np.cumsum(same, axis=1) <= agree)) @ (1 << np.arange(blocks))]


def foreign_pairs(marks: np.ndarray, roots: np.ndarray, mask: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place in marks with those of other roots up to WIDE bits away whose first common mask is the given one."""
    order = np.argsort(np.bitwise_count(marks ^ pivots()[0]), kind="stable")
    for i, near in near_pairs(marks[order], WIDE):
        i, near = order[i], order[near]
        near = near[roots[near] != roots[i]]
        near = near[first_masks(marks[near] ^ marks[i]) == mask]
        if len(near):
            yield int(i), near


def _suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, t, fp, root) of the members of each bucket that foreign_pairs names, each once a bucket."""
    for batch in batches:
        place, mask = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
        starts = batch.column(2).offsets.to_numpy().astype(np.int64)
        marks, roots = (batch.column(x).values.to_numpy() for x in (2, 3))
        sizes, found, owner = np.diff(starts), [], []
        two = np.flatnonzero(sizes == 2)
        at = starts[:-1][two]
        a, b = (marks[x].view(np.uint64) for x in (at, at + 1))
        stay = survivors(distances(a), distances(b), WIDE) & (np.bitwise_count(a ^ b) <= WIDE) & (roots[at] != roots[at + 1]) & (first_masks(a ^ b) == mask[two])
        for shift in (0, 1):
            found.append(at[stay] + shift)
            owner.append(two[stay])
        for k in np.flatnonzero(sizes > 2).tolist():
            part = slice(starts[k], starts[k + 1])
            met = [np.append(near, i) for i, near in foreign_pairs(marks[part].view(np.uint64), roots[part], mask[k])]
            if met:
                met = np.unique(np.concatenate(met))
                found.append(starts[k] + met)
                owner.append(np.full(len(met), k))
        found, owner = np.concatenate(found), np.concatenate(owner)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[owner], mask[owner], marks[found], roots[found])], ["place", "t", "fp", "root"])


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes([x.as_py()])[0]).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["fp", "shingles"])


def similar_roots(marks: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], mask: int, least: float) -> list[tuple[int, int]]:
    """Links between the roots of one bucket, a spanning forest of those that foreign_pairs with similar enough sets make."""
    parent, links = {int(x): int(x) for x in roots}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, near in foreign_pairs(marks, roots, mask):
        for j in near.tolist():
            a, b = top(int(roots[i])), top(int(roots[j]))
            few, many = sorted((len(sets[i]), len(sets[j])))
            if a == b or few < least * many:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= least * max(1, few + many - shared):
                parent[b] = a
                links.append((int(roots[i]), int(roots[j])))
    return links


def _similar(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (place, i, j, t, fp, root, shingles) come sorted by bucket, of which one is held at a time."""

    def linked(held: list[tuple]) -> pa.RecordBatch:
        marks, roots = (np.array([x[k] for x in held], np.int64) for k in (1, 2))
        links = similar_roots(marks.view(np.uint64), roots, [np.frombuffer(x[3], np.uint64) for x in held], held[0][0], least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    last, held = None, []
    for batch in batches:
        for *bucket, t, fp, root, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and len(held) > 1:
                yield linked(held)
            if bucket != last:
                last, held = bucket, []
            held.append((t, fp, root, shingles))
    if len(held) > 1:
        yield linked(held)


#: Bytes of shingle sets of one bucket that a task holds at once; larger buckets are cut into chunks that meet two at a time.
HELD = 32 << 20


def wide_links(docs: DataFrame, named: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between roots of named(fp, root, first, h) with fingerprints up to WIDE bits apart whose texts are similar enough.

    first and h name the text that stands for a fingerprint, a row of documents; the similarity is the Jaccard similarity of
    5-word shingles. Pairs that no mask shows are missed: none up to 5 bits, about a fifth at 7, half at 9.

    A first pass over the buckets names the members that have a candidate of another root, each pair under its first mask alone;
    only these take their shingle sets to their bucket, where pairs are verified until one forest joins all that are alike. So what leaves a
    task is at most the members of its buckets, never their pairs.
    """
    placed = _placed(named.where("first is not null").select("fp", "root"), WIDE, WIDE_BLOCKS, WIDE_AGREE)
    lists = placed.groupBy(*_PLACE).agg(F.collect_list(F.struct("fp", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    lists = lists.select(F.xxhash64(*_PLACE).alias("place"), "t", F.col("m.fp").alias("fps"), F.col("m.root").alias("roots"))
    found = cut(lists.mapInArrow(given_back(_suspects), "place long, t int, fp long, root long"))
    ends = named.join(found.select("fp").distinct(), "fp").select("fp", F.col("first").alias("doc_id"), "h")
    texts = docs.select(*_identity(docs), text_or_empty().cast("binary").alias("text")).join(ends, ["doc_id", "h"]).groupBy("fp").agg(F.min("text").alias("text"))
    sets = cut(texts.mapInArrow(given_back(_shingle_sets), "fp long, shingles binary"))
    weights = cut(found.join(sets.select("fp", F.length("shingles").alias("bytes")), "fp").groupBy("place").agg(F.sum("bytes").alias("bytes")))
    rows = _chunked(found.join(weights, "place"), F.greatest(F.lit(1), F.ceil(F.col("bytes") / HELD)).cast("int"))
    rows = rows.join(sets, "fp").select("place", "i", "j", "t", "fp", "root", "shingles").repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
    return rows.mapInArrow(given_back(lambda x: _similar(x, similarity)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents.

    component_id is the smallest doc_id that links of at most RADIUS differing bits reach. Rows with equal
    fingerprints (copies, and all texts without words, whose fingerprint is zero) form one node, so groups of copies
    never become pairs. A null doc_id keeps its row and never names a component of others. Repeated rows come back
    as often as they came; an empty table gives an empty one; other columns are not read.
    """
    return _rooted(docs).select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, wide: bool = False) -> DataFrame:
    """near_duplicates with h, the text's hash, and root, which tells components apart whose smallest doc_id is the same.

    With wide, wide_links join these components further.
    """
    marked = cut(fingerprints(docs))
    firsts = cut(marked.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("x"), F.count("*").alias("n")).select("fp", F.col("x.doc_id").alias("first"), F.col("x.h").alias("h"), "n"))
    roots = connected_components(fingerprint_links(firsts.select("fp")))
    named = cut(firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", "h", "n", F.coalesce("root", "fp").alias("root")))
    # a component may hold most fingerprints, so rows meet their root's row by a salted join
    per = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m")))
    if wide:
        tops = connected_components(wide_links(docs, named)).withColumnRenamed("root", "top")
        per = cut(per.join(tops, per.root == tops.node, "left").select("root", F.coalesce("top", "root").alias("top"), "component_id", "m"))
        least = cut(per.groupBy("top").agg(F.min("component_id").alias("least"), F.count("*").alias("k")))
        per = cut(join_counted(per, least, ["top"], "k").select("root", "top", F.col("least").alias("component_id"), "m"))
    else:
        per = per.withColumn("top", F.col("root"))
    names = cut(join_counted(named.select("fp", "root", "n"), per, ["root"], "m").select("fp", "component_id", F.col("top").alias("root"), "n"))
    return join_counted(marked, names, ["fp"], "n")


def fingerprint_hex(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, wide: bool = False) -> DataFrame:
    """documents with one row of each component: that of the smallest (doc_id, fingerprint, text hash); all columns stay, whatever their names.

    Components are those of near_duplicates, and with wide wide_links join them too. Rows are told apart by doc_id and
    text, so a doc_id that repeats with other texts loses only those that have a smaller near copy. Of rows equal in both, one stays: the
    first by a hash of the other columns. Rows without a doc_id all stay and remove nothing. Null and empty texts, and all
    texts without words, are one component. An empty table gives an empty one.
    """
    found = cut(_rooted(docs, wide))
    known = found.where("doc_id is not null")
    best = known.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "h")).alias("x")).select("x.doc_id", "x.h")
    stay = cut(known.join(best, ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.count("*").alias("n")))
    i, h, k_i, k_h, place = fresh(docs, "id__", "hash__", "stay_id__", "stay_hash__", "place__")
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(text_or_empty())})

    def those(condition: str) -> DataFrame:
        named = stay.where(condition).select(F.col("doc_id").alias(k_i), F.col("h").alias(k_h))
        return rows.join(named, (F.col(i) == F.col(k_i)) & (F.col(h) == F.col(k_h)), "left_semi")

    kept = those("n = 1").select(*docs.columns).union(docs.where("doc_id is null"))
    if stay.where("n > 1").limit(1).count():
        others = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
        order = Window.partitionBy(i, h).orderBy(F.xxhash64(*others))
        kept = kept.union(those("n > 1").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns))
    return kept
