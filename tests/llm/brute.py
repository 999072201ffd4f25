"""Plain versions of the operators, for tests."""

import hashlib
import re
import zlib

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """rows of (doc_id, fingerprint) -> smallest reachable doc_id of each fingerprint."""
    marks = sorted({f for _, f in rows})
    parent = {f: f for f in marks}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return {f: least.get(top(f)) for f in marks}


def repeated_strings(rows):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49 if d is not None else 0):
            w = data[i : i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 49 if d is not None else 0):
            if first[data[i : i + 50]] < d:
                covered[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(data)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((d, len(data), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(data, covered, strict=True) if not c)).hexdigest()))
    return out


def rules(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def chained_hash(*values):
    """xxhash64 of Spark over ints (4 bytes), longs (8 bytes, given as ('long', x)) and strings; nulls are passed over. Signed."""
    h = 42
    for v in values:
        if isinstance(v, tuple):
            v = None if v[1] is None else v[1].to_bytes(8, "little", signed=True)
        elif isinstance(v, int):
            v = v.to_bytes(4, "little", signed=True)
        elif isinstance(v, str):
            v = v.encode()
        if v is not None:
            h = xxhash.xxh64(v, seed=h % 2**64).intdigest()
    return h - 2**64 if h >> 63 else h


def interleaved(rows, shards=8):
    """(doc_id, shard, slot) of rows (doc_id, text, source), sorted."""
    sources = {}
    for d, t, s in rows:
        t = t or ""
        mark = chained_hash(77, ("long", d), t)
        sources.setdefault(s, []).append((mark, d is not None, d or 0, zlib.crc32(t.encode()), len(t.encode()) + 1, d))
    order = []
    for s, held in sources.items():
        for i, x in enumerate(sorted(held)):
            order.append(((i + 0.5) / len(held), s is None, s or "", *x))
    out, counts, n = [], [0] * shards, len(order)
    for place, x in enumerate(sorted(order)):
        shard = place * shards // n
        out.append((x[-1], shard, counts[shard]))
        counts[shard] += 1
    return out


def words_of_shard(shard, passes, blocks, start, block=32):
    """Words taken of each document of a shard, (key, size) in order: word by word, by the block that each stands in."""
    total = sum(n for _, n in shard)
    full = total // block
    chosen = {(start + i) % full for i in range(blocks)}
    assert len(chosen) == blocks
    out, at = [], 0
    for key, n in shard:
        out.append((key, sum(passes + (w // block in chosen) for w in range(at, at + n))))
        at += n
    return out


def minhash(text, permutations, a, b, base, mix, order):
    """Least values of the permuted shingle hashes of a UTF-8 text in plain integers, 16 low bits each."""
    m = 2**64
    words = []
    for w in WORDS.findall(text):
        h = sum((x + 1) * pow(base, i, m) for i, x in enumerate(w.encode())) % m
        h = (h ^ h >> 31) * mix % m
        words.append(h ^ h >> 29)
    grams = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    hashes = []
    for g in grams:
        h = sum(x * order[i] for i, x in enumerate(g)) % m
        h = (h ^ h >> 30) * mix % m
        hashes.append(h ^ h >> 27)
    return "".join(f"{min([((h * a[k] + b[k]) % m) >> 32 for h in hashes], default=2**32 - 1) & 0xFFFF:04x}" for k in range(permutations))


def jaccard(a, b):
    """Of the sets of 5-word shingles of two texts."""
    sets = []
    for t in (a, b):
        w = WORDS.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))
