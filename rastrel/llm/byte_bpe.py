"""Byte-level BPE through a sentencepiece model written directly from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, text_or_empty

#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000


def _symbols() -> list[str]:
    """A visible character for each byte: itself where it is a printable Latin-1 character, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


SYMBOLS = _symbols()
_MAP = {b: s for b, s in enumerate(SYMBOLS)}


def _mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """A protocol buffer field: length-delimited, varint or 32-bit float by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: one unknown piece, then every token as its byte characters, scored by its negative rank.

    Normalisation is the identity, without a dummy prefix, trimming or escaped spaces. Piece i + 1 is the token of the
    i-th smallest rank.
    """
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, _mapped(token)) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts as the rank file's library would, without special tokens.

    A pre-token that is itself a token is that token; any other goes through the sentencepiece model, whose merges take
    the lowest rank first and the leftmost among equals.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([0, *(r for _, r in by_rank)], "<u4")
        self.token_of_rank = {r: t for t, r in by_rank}
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = np.array([rank], "<u4").tobytes() if rank is not None else self.rank_of_piece[self.model.encode(_mapped(data))].tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(data) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, make = self.known.get, self._ids
        return b"".join([known(x) or make(x) for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.token_of_rank.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker process."""
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of documents(doc_id, text).

    path names the rank file on every executor. Null texts count as empty: no tokens, the hash of no bytes. Repeated rows
    each get a row; an empty table gives none; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for x in batch.column(1):
                ids = c.encode(x.as_py())
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.known.clear()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(given_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with ids as an array of ranks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(c.encode(x.as_py()), "<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are not UTF-8 become replacement characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
