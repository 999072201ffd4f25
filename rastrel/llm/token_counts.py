"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
LIMIT = 4096
#: Distinct chunks that a worker remembers before it starts anew, and the longest chunk that it remembers.
REMEMBERED, LONGEST = 600_000, 48


class Counter(dict):
    """Counts tokens as the model's library does, without making any identifier.

    Spaces become U+2581 and one stands before the text. No piece of the vocabulary has another character before a
    U+2581, so merges never cross the start of a run of them, nor a newline where no longer piece holds one: texts are
    cut there into chunks whose counts add up, and counts of short chunks are kept in this dict.
    """

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        crossing = any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        inside = any("\n" in p and len(p) > 1 for p in self.rank)
        self.cut = (lambda text: [text]) if crossing or inside else regex.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    def merged(self, chunk: str) -> int:
        """Symbols of a chunk less the merges: a heap holds adjacent pairs by rank, then place, and a linked list their neighbours.

        A character outside the vocabulary that no merge takes in counts once for each of its UTF-8 bytes.
        """
        rank, parts, n = self.rank, list(chunk), len(chunk)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := pair + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := parts[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges + sum(len(p.encode()) - 1 for p in parts if len(p) == 1 and p not in rank)

    def __missing__(self, chunk: str) -> int:
        count = self.merged(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; none of an empty one."""
        return sum(map(self.__getitem__, self.cut(SPACE + text.replace(" ", SPACE)))) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for a worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of documents(doc_id, text).

    path names the sentencepiece model on every executor. Null texts count as empty, with no bytes or tokens. Repeated
    rows each get a row; an empty table gives none; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            sizes, counts = [], []
            for x in batch.column(1):
                text = x.as_py()
                sizes.append(len(text.encode()))
                counts.append(c.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
