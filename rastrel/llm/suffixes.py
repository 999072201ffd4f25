"""Removal of repeated byte strings by a distributed merge sort of front-coded suffix runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, text_or_empty

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Suffixes are sampled at anchors: in any LENGTH bytes, the start of the GRAM bytes with the least hash is one.
GRAM = 20
SPAN = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: Documents that share a gram from which its anchor is replaced by all the strings of LENGTH bytes around it.
HOT = 100_000
#: Bytes of a chunk of documents, of a bucket's share of the text, and of what is hashed at a time; chunks and buckets grow with
#: the square root of the text, up to MOST_CHUNK and MOST_BUCKET, beyond LARGE bytes.
CHUNK_BYTES, BUCKET_BYTES, STRIDE = 4 << 20, 64 << 20, 1 << 18
LARGE, MOST_CHUNK, MOST_BUCKET = 1 << 37, 64 << 20, 512 << 20
#: Bytes on either side of a piece of a long text that decide its anchors and what stands around them.
MARGIN = 2 * LENGTH

_M = np.uint64(0x9E3779B97F4A7C15)
_B = 0x2545F4914F6CDD1D
_NONE = np.uint32(0xFFFFFFFF)
_WINDOW = np.random.default_rng(50).integers(0, 2**63, LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every width neighbours, by doubling."""
    m = 1
    while 2 * m <= width:
        x = pick(x[:-m], x[m:])
        m *= 2
    return pick(x[: len(x) - (width - m)], x[width - m :]) if m < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in data, texts of LENGTH bytes or more that end at ends, and their 48-bit gram hashes.

    Which positions of a text are anchors depends on the bytes around them alone, so equal strings of LENGTH bytes have
    an anchor at the same place wherever they stand.
    """
    run, length, power, rest, out, have = (data.astype(np.uint64) + np.uint64(1)) * _M, 1, _B, GRAM, None, 0
    while True:
        if rest & 1:
            n = len(data) - have - length + 1
            out, have = (run[:n] if out is None else out[:n] * np.uint64(power) + run[have : have + n]), have + length
        rest >>= 1
        if not rest:
            break
        run = run[:-length] * np.uint64(power) + run[length:]
        power, length = power * power % 2**64, 2 * length
    full = _mix(out)
    order = (full >> np.uint64(32)).astype(np.uint32)
    across = (ends[:-1, None] - np.arange(1, GRAM)[None, :]).ravel()
    order[across] = _NONE
    least = _slide(order, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint32)
    most = _slide(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    chosen = order == most
    chosen[across] = False
    at = np.flatnonzero(chosen)
    # anchors are places of small high bits; the low ones spread them evenly over buckets
    return at, full[at] & np.uint64(2**48 - 1)


def _batches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of up to about STRIDE bytes: the bytes, where each text or piece in them ends, its text's number, and where it starts there.

    A text above STRIDE bytes comes in pieces, which overlap by twice the MARGIN.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > STRIDE:
            for start in range(0, len(texts[at]), STRIDE):
                lo, hi = max(0, start - MARGIN), min(len(texts[at]), start + STRIDE + MARGIN)
                yield np.frombuffer(texts[at], np.uint8, hi - lo, lo), np.array([hi - lo]), np.array([at]), np.array([lo])
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= STRIDE):
            size += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), np.cumsum([len(x) for x in texts[at:to]]), np.arange(at, to), np.zeros(to - at, np.int64)
        at = to


def _anchored(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each portion its bytes and, of its anchors: the place in it, the gram's hash, the text's number, the place in the text.

    A piece gives the anchors of its core alone, which its margins make the same as in the whole text.
    """
    for data, ends, number, offset in _batches(texts):
        if ends[-1] < LENGTH:
            continue
        at, hashes = anchors(data, ends)
        of = np.searchsorted(ends, at, side="right")
        place = at - np.concatenate([[0], ends[:-1]])[of] + offset[of]
        if len(texts[number[0]]) > STRIDE:
            core = offset[0] + (MARGIN if offset[0] else 0)
            stay = (place >= core) & (place < core + STRIDE)
            at, hashes, of, place = at[stay], hashes[stay], of[stay], place[stay]
        yield data, at, hashes, number[of], place


_SIDE = "chunk int, kind int, doc_id long, k long, blob binary"
_REP, _SHARED, _MARK = 0, 1, 2


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    head = np.array([len(columns[0]) if columns else 0], "<u4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, data, at, out = int(np.frombuffer(blob[:4], "<u4")[0]), zstandard.ZstdDecompressor().decompress(blob[4:]), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _chunk_texts(rows: pa.Table, side: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """Doc ids, hashes and texts of a chunk that are the first of their copies, in an order that every pass sees alike."""
    kind = np.asarray(side.column("kind"))
    first = set(zip(side.column("doc_id").filter(pa.array(kind == _REP)).to_pylist(), side.column("k").filter(pa.array(kind == _REP)).to_pylist(), strict=True))
    texts = {(d, k): t for d, k, t in zip(rows.column("doc_id").to_pylist(), rows.column("k").to_pylist(), rows.column("text"), strict=True) if (d, k) in first}
    keys = sorted(texts)
    return [d for d, _ in keys], [k for _, k in keys], [texts[x].as_py() for x in keys]


def _blobs(side: pa.Table, kind: int) -> list[bytes]:
    return side.column("blob").filter(pa.array(np.asarray(side.column("kind")) == kind)).to_pylist()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 48-bit hashes, ascending with them."""
    return ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])


def _gram_runs(buckets: int):
    """First pass: a chunk's distinct gram hashes, sorted, and in how many of its documents each stands."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        _, _, texts = _chunk_texts(rows, side)
        found = []
        for _, _, hashes, owner, _ in _anchored(texts):
            by = np.lexsort((owner, hashes))
            found.append((hashes[by], owner[by]))
            new = np.concatenate([[True], (found[-1][0][1:] != found[-1][0][:-1]) | (found[-1][1][1:] != found[-1][1][:-1])]) if len(by) else np.zeros(0, bool)
            found[-1] = (found[-1][0][new], found[-1][1][new])
        hashes, owner = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        by = np.lexsort((owner, hashes))  # pieces of one text may repeat a gram
        hashes, owner = hashes[by], owner[by]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(by) else np.zeros(0, bool)
        grams, count = np.unique(hashes[new], return_counts=True)
        bucket = _bucket(grams, buckets)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
        out = [(int(bucket[a]), side.column("chunk")[0].as_py(), _pack(np.diff(grams[a:b], prepend=np.uint64(0)), count[a:b].astype("<u4"))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

    return run


def _shared_grams(hot: int):
    """A bucket's grams that stand in two documents or more, back to the chunks they came from.

    Chunks are made of different documents, and each sends a gram once, so a gram costs a row a chunk at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [(c.as_py(), *_unpack(b.as_py(), "<u8", "<u4")) for batch in batches for c, b in zip(batch.column(1), batch.column(2), strict=True)]
        if not sent:
            return
        grams, of = np.concatenate([np.cumsum(g, dtype=np.uint64) for _, g, _ in sent]), np.repeat(np.arange(len(sent)), [len(g) for _, g, _ in sent])
        count = np.concatenate([n for *_, n in sent]).astype(np.int64)
        by = np.argsort(grams, kind="stable")
        grams, of, count = grams[by], of[by], count[by]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        total = np.repeat(np.add.reduceat(count, starts), np.diff(np.append(starts, len(grams))))
        keep = total > 1
        grams, of, hots = grams[keep], of[keep], (total[keep] > hot).astype(np.uint8)
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(len(sent) + 1))
        out = [(sent[i][0], _pack(np.diff(grams[x], prepend=np.uint64(0)), hots[x])) for i in range(len(sent)) if edges[i] < edges[i + 1] for x in [by[edges[i] : edges[i + 1]]]]
        yield _side_rows(out, _SHARED)

    return run


def _side_rows(rows: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["chunk", "kind", "doc_id", "k", "blob"])


def _common(strings: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before; 0 for the first."""
    same = strings[1:] == strings[:-1]
    return np.concatenate([[0], np.where(same.all(axis=1), strings.shape[1], same.argmin(axis=1))]).astype(np.uint8) if len(strings) else np.zeros(0, np.uint8)


def _front_coded(strings: np.ndarray, common: np.ndarray) -> bytes:
    """A sorted run: for each row its common prefix with the row before and the bytes after that."""
    return strings[np.arange(strings.shape[1])[None, :] >= common[:, None]].tobytes()


def _decoded(rest: bytes, common: np.ndarray) -> list[bytes]:
    out, at, last = [], 0, b""
    for c in common.tolist():
        to = at + LENGTH - c
        last = last[:c] + rest[at:to]
        out.append(last)
        at = to
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs, each its strings of one length and their common prefixes with the one before in the run.

    Returns the run, the place in it, and the common prefix with the string before, of every string in order. A loser tree
    keeps with each loser its common prefix with the string that beat it, which is the last one put out along the winner's
    path. Of two with different prefixes the longer is the smaller, unread; of two with equal ones only the bytes after
    the prefix are read. A winner's next string brings its prefix from the run's front coding.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (k - len(runs))
    place = [0] * k
    known = [0 if s else -1 for s in strings]
    head = [s[0] if s else b"" for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs with equal known prefixes; the loser's prefix becomes that with the winner."""
        at = known[a]
        if at < 0:
            return a, b
        x, y = head[a][at:], head[b][at:]
        if x == y:
            a, b = (a, b) if a < b else (b, a)
            known[b] = at + len(x)
            return a, b
        if y < x:
            a, b = b, a
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        known[b] = at + len(x) - (differ.bit_length() + 7) // 8
        return a, b

    losers, up = [0] * k, list(range(k))
    while len(up) > 1:
        base, nxt = len(up) // 2, []
        for i in range(base):
            a, b = up[2 * i], up[2 * i + 1]
            w, x = (a, b) if known[a] > known[b] else (b, a) if known[b] > known[a] else play(a, b)
            losers[base + i] = x
            nxt.append(w)
        up = nxt
    winner = up[0]
    out_run, out_place, out_prefix = [], [], []
    while known[winner] >= 0:
        out_run.append(winner)
        p = place[winner]
        out_place.append(p)
        out_prefix.append(known[winner])
        p += 1
        if p < len(strings[winner]):
            place[winner], head[winner], known[winner] = p, strings[winner][p], prefixes[winner][p]
        else:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            a, b = known[winner], known[other]
            if b > a:
                losers[node], winner = winner, other
            elif a == b and a >= 0:
                winner, losers[node] = play(winner, other)
            node >>= 1
    return out_run, out_place, out_prefix


def _joined_runs(owner: np.ndarray, place: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors, ordered by owner and place, stay for those with the same context at most LENGTH bytes on in the same text, and their reach.

    What is removed around the anchors of such a run is one part, from the first one's start to the last one's end. A text that
    repeats itself closely so sends a context once and not at every place.
    """
    by = np.lexsort((place, _row_hash(whole), owner))
    o, p, w = owner[by], place[by], whole[by]
    goes_on = np.concatenate([[False], (o[1:] == o[:-1]) & (p[1:] - p[:-1] <= LENGTH) & (w[1:] == w[:-1]).all(axis=1)])
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(by)) - 1
    return by[first], p[last] - p[first]


def _contexts(texts: list[bytes], grams: np.ndarray, hots: np.ndarray, buckets: int) -> Iterator[list[np.ndarray]]:
    """bucket, after, before, left, right, reach, owner, place of the texts' suffixes at shared anchors, a portion at a time."""
    for data, at, hashes, owner, place in _anchored(texts):
        where = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        found = grams[where] == hashes
        at, hashes, owner, place, hot = at[found], hashes[found], owner[found], place[found], hots[where[found]] == 1
        sizes = np.array([len(texts[i]) for i in owner.tolist()], np.int64)
        left, right = np.minimum(place, LEFT), np.minimum(sizes - place, LENGTH)
        if hot.any():  # every string of LENGTH bytes around a hot anchor, without what stands before
            far = (at[hot][:, None] - np.arange(SPAN)[None, :]).ravel()
            spot, of, size = (place[hot][:, None] - np.arange(SPAN)[None, :]).ravel(), np.repeat(owner[hot], SPAN), np.repeat(sizes[hot], SPAN)
            inside = (spot >= 0) & (spot + LENGTH <= size)
            far, one = np.unique(far[inside], return_index=True)
            spot, of = spot[inside][one], of[inside][one]
            at, owner, place = np.concatenate([at[~hot], far]), np.concatenate([owner[~hot], of]), np.concatenate([place[~hot], spot])
            left, right = np.concatenate([left[~hot], np.zeros(len(far), np.int64)]), np.concatenate([right[~hot], np.full(len(far), LENGTH)])
            hashes = np.concatenate([hashes[~hot], np.zeros(len(far), np.uint64)])
        if not len(at):
            continue
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        after = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[at + LEFT]
        after[np.arange(LENGTH, dtype=np.uint8)[None, :] >= right.astype(np.uint8)[:, None]] = 0
        before = np.lib.stride_tricks.sliding_window_view(padded, LEFT)[at][:, ::-1].copy()
        before[np.arange(LEFT, dtype=np.uint8)[None, :] >= left.astype(np.uint8)[:, None]] = 0
        whole = np.concatenate([after, before, left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None]], axis=1)
        stay, reach = _joined_runs(owner, place, whole)
        after, before, left, right, owner, place, hashes = (x[stay] for x in (after, before, left, right, owner, place, hashes))
        spread = np.flatnonzero((left == 0) & (hashes == 0))
        if len(spread):
            hashes[spread] = _mix((after[spread].astype(np.uint64) * _WINDOW[None, :]).sum(axis=1, dtype=np.uint64)) >> np.uint64(16)
        yield [_bucket(hashes, buckets), after, before, left.astype(np.uint8), right.astype(np.uint8), reach.astype("<u4"), owner.astype("<u4"), place.astype("<u4")]


def _suffix_runs(buckets: int):
    """Second pass: the chunk's sorted, front-coded runs of the suffixes at its shared anchors, and what it can mark itself."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        chunk = side.column("chunk")[0].as_py()
        shared = [_unpack(b, "<u8", "u1") for b in _blobs(side, _SHARED)]
        out: list[tuple[int, int, bytes]] = []
        if shared:
            grams = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in shared])
            by = np.argsort(grams)
            grams, hots = grams[by], np.concatenate([h for _, h in shared])[by]
            ids, _, texts = _chunk_texts(rows, side)
            parts = list(_contexts(texts, grams, hots, buckets))
            if parts:
                bucket, after, before, left, right, reach, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                del parts
                doc = np.array(ids, "<i8")[owner]
                # the same context in several of the chunk's documents is sent once, for the smallest doc_id
                whole = np.concatenate([after, before, left[:, None], right[:, None]], axis=1)
                code = _row_hash(whole)
                same = np.lexsort((doc, code))
                code = code[same]
                starts = np.concatenate([[True], (code[1:] != code[:-1]) | (whole[same[1:]] != whole[same[:-1]]).any(axis=1)])
                del whole
                least = doc[same][np.flatnonzero(starts)][np.cumsum(starts) - 1]
                repeat = doc[same] > least
                gone = same[repeat]
                if len(gone):
                    out.append((-1, chunk, _pack(owner[gone], (at[gone] - left[gone]).astype("<u4"), (at[gone] + right[gone] + reach[gone]).astype("<u4"))))
                stay = same[~repeat]
                by = stay[np.lexsort((np.ascontiguousarray(after[stay]).view(f"S{LENGTH}").ravel(), bucket[stay]))]
                bucket = bucket[by]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    x = by[a:b]
                    common = _common(after[x])
                    rest = zstandard.ZstdCompressor(level=1).compress(_front_coded(after[x], common))
                    table = _pack(common, left[x], right[x], owner[x], doc[x], at[x], reach[x], *before[x].T)
                    out.append((int(bucket[a]), chunk, np.array([len(table)], "<u4").tobytes() + table + rest))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

    return run


def _row_hash(rows: np.ndarray) -> np.ndarray:
    code = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        code = (code ^ rows[:, i]) * _M
        code ^= code >> np.uint64(31)
    return code


def _merged_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a bucket's runs and sends each chunk the parts of its documents that stand in a smaller document too.

    In suffix order, the strings that share n bytes after the anchor are those between common prefixes below n, so for
    each offset of the anchor in a string of LENGTH bytes the class of what follows is a running count. So is that of what
    stands before, in the order of the reversed bytes there. Nothing is told alike by a hash. Strings around one anchor all hold it,
    so their union is one part, which a suffix that stands for a run of anchors stretches by its reach.
    """
    chunks, runs, tables = [], [], []
    for batch in batches:
        for c, b in zip(batch.column(1), batch.column(2), strict=True):
            blob = b.as_py()
            size = int(np.frombuffer(blob[:4], "<u4")[0])
            table = _unpack(blob[4 : 4 + size], "u1", "u1", "u1", "<u4", "<i8", "<u4", "<u4", *["u1"] * LEFT)
            runs.append((_decoded(zstandard.ZstdDecompressor().decompress(blob[4 + size :]), table[0]), table[0].tolist()))
            chunks.append(c.as_py())
            tables.append(table)
    if not runs:
        return
    run, place, prefix = (np.array(x, np.int64) for x in merge(runs))
    base = np.concatenate([[0], np.cumsum([len(t[0]) for t in tables])])
    by = base[run] + place
    del runs
    left, right, owner, doc, at, reach = (np.concatenate([t[i] for t in tables])[by] for i in range(1, 7))
    before = np.stack([np.concatenate([t[7 + i] for t in tables])[by] for i in range(LEFT)], axis=1)
    back = np.argsort(np.ascontiguousarray(before).view(f"S{LEFT}").ravel(), kind="stable")
    known = np.empty(len(by), np.int64)
    known[back] = _common(before[back])
    low, high = np.full(len(by), 255, np.int64), np.full(len(by), -1, np.int64)
    held = np.empty(len(by), np.int64)
    for offset in range(SPAN):
        valid = np.flatnonzero((left >= offset) & (right >= LENGTH - offset))
        if not len(valid):
            continue
        # a change of class anywhere between two suffixes parts them, valid or not
        held[back] = np.cumsum(known[back] < offset)
        code = (np.cumsum(prefix < LENGTH - offset) * (len(by) + 1) + held)[valid]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[valid][order], starts), np.diff(np.append(starts, len(order))))
        marked = valid[order][doc[valid][order] > least]
        low[marked] = np.minimum(low[marked], offset)
        high[marked] = offset
    hit = np.flatnonzero(high >= 0)
    hit = hit[np.argsort(run[hit], kind="stable")]
    edges = np.searchsorted(run[hit], np.arange(len(chunks) + 1))
    out = []
    for i, c in enumerate(chunks):
        x = hit[edges[i] : edges[i + 1]]
        if len(x):
            out.append((c, _pack(owner[x], (at[x] - high[x]).astype("<u4"), (at[x] + LENGTH - low[x] + reach[x]).astype("<u4"))))
    if out:
        yield _side_rows(out, _MARK)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept_parts(size: int, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end)."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by].astype(np.int64), np.maximum.accumulate(end[by].astype(np.int64))
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return list(zip(start[new].tolist(), reach[last].tolist(), strict=True))


def _with_removed(rows: pa.Table, side: pa.Table) -> Iterator[tuple[int, int | None, bytes, list[tuple[int, int]]]]:
    """Row number, doc_id, text and removed runs of each row of a chunk."""
    ids, keys, _ = _chunk_texts(rows, side)
    number = {x: i for i, x in enumerate(zip(ids, keys, strict=True))}
    marks = [_unpack(b, "<u4", "<u4", "<u4") for b in _blobs(side, _MARK)]
    owner, start, end = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else [np.zeros(0, "<u4")] * 3
    by = np.argsort(owner, kind="stable")
    owner, start, end = owner[by], start[by], end[by]
    for i, (d, k, t) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("k").to_pylist(), rows.column("text"), strict=True)):
        text, runs = t.as_py(), []
        if (d, k) in number:
            a, b = np.searchsorted(owner, [number[d, k], number[d, k] + 1])
            runs = _kept_parts(len(text), start[a:b], end[a:b]) if a < b else []
        elif d is not None and len(text) >= LENGTH:
            runs = [(0, len(text))]  # a copy of a smaller document's text
        yield i, d, text, runs


def _remaining(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _report(rows: pa.Table, side: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    for _, d, text, runs in _with_removed(rows, side):
        for c, v in zip(out, (d, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_remaining(text, runs)).hexdigest()), strict=True):
            c.append(v)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, [*[pa.int64()] * 4, pa.string()], strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def _texts(rows: pa.Table, side: pa.Table) -> pa.Table:
    found = [(d, _remaining(t, r).decode(errors="replace")) for _, d, t, r in _with_removed(rows, side)]
    return pa.Table.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["doc_id", "text"])


def _run(docs: DataFrame, last, schema: str, hot: int) -> DataFrame:
    spark = docs.sparkSession
    text = text_or_empty()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("text"))
    narrow = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), F.unhex(F.sha2(text, 256)).alias("k2"), F.octet_length(text).alias("n")))
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide, grown = partitions(spark), max(1.0, math.sqrt(total / LARGE))
    chunks = max(wide, math.ceil(total / min(MOST_CHUNK, CHUNK_BYTES * grown)))
    buckets = max(wide, math.ceil(total / min(MOST_BUCKET, BUCKET_BYTES * grown)))
    chunk = F.pmod(F.xxhash64("doc_id", "k"), F.lit(chunks)).cast("int").alias("chunk")
    reps = narrow.where(f"doc_id is not null and n >= {LENGTH}").groupBy("k", "k2", "n").agg(F.min("doc_id").alias("doc_id"))
    # a text too short to lose anything is as good as the first of its copies; one side row a chunk makes it known in every pass
    reps = cut(reps.select(chunk, F.lit(_REP).alias("kind"), "doc_id", "k", F.lit(None).cast("binary").alias("blob")))
    every = spark.range(chunks).select(F.col("id").cast("int").alias("chunk"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("binary").alias("blob"))
    rows = base.select(chunk, "doc_id", "k", "text")

    def chunked(side: DataFrame, function, out: str) -> DataFrame:
        return rows.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(function, out)

    sent = "bucket int, chunk int, blob binary"
    known = reps.union(every)
    grams = chunked(known, _gram_runs(buckets), sent).repartitionById(buckets, F.col("bucket"))
    shared = grams.mapInArrow(_shared_grams(hot), _SIDE)
    runs = chunked(known.union(shared), _suffix_runs(buckets), sent)
    # bucket -1 holds what the chunks marked themselves; its rows are passed on as they are, by chunk
    place = F.when(F.col("bucket") < 0, F.pmod(F.col("chunk"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    marks = runs.repartitionById(buckets, place).mapInArrow(_marks_of_bucket, _SIDE)
    return chunked(known.union(marks), last, schema)


def _marks_of_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = []
    for batch in batches:
        own = np.asarray(batch.column(0)) < 0
        if own.any():
            passed = batch.filter(pa.array(own))
            yield _side_rows(list(zip(passed.column(1).to_pylist(), passed.column(2).to_pylist(), strict=True)), _MARK)
        rest.append(batch.filter(pa.array(~own)))
    yield from _merged_marks(rest)


def repeated_strings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """What every row of documents(doc_id, text) loses: bytes in a string of LENGTH bytes that a smaller doc_id holds too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256. Matches never cross documents;
    null texts count as empty. Rows with one doc_id never remove from each other; a row with a null doc_id neither loses
    nor removes anything. Repeated rows each get a row; an empty table gives none; other columns are not read.

    Documents are dealt into chunks by doc_id and text, so neither null doc_ids nor one that repeats fill a chunk; a text that is a
    copy of a smaller document's (by SHA-256) is lost whole and takes no further part. Long texts are worked through in pieces. Sorting every suffix would move fifty times the text, so suffixes are sampled at anchors, which loses
    no string of LENGTH bytes. Grams that only one document holds go first; the rest of the suffixes are sorted in their
    chunk, sent front-coded to their bucket and merged by loser trees. A context that many documents of a chunk share is
    sent once. Grams in over `hot` documents are sent as all strings around them, in buckets of their own, so that no
    bucket holds all that follows a common gram.
    """
    return _run(docs, _report, RESULT, hot)


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text) with the repeated strings removed, for every row of documents; bytes cut from a character become U+FFFD."""
    return _run(docs, _texts, "doc_id long, text string", hot)
