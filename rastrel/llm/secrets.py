"""Secret scans: base patterns, and zstandard novelty of strings in sensitive context."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, text_or_empty

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "novel")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Words that make their surroundings sensitive, and what may be a secret there.
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|(?:api|private|access)[ _-]?key|credential|bearer|authorization|connection[ _-]?string|signature", re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: A value or key of a run: '=' belongs to it only as padding at the run's end.
_PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
#: What of a key follows its sensitive word, to the separator that ends the key.
_KEY_END = re.compile(r"(?i:ords?|ds?|s)?(?i:[_-](?:keys?|ids?|value))*(?:[_-]|\Z)")
#: A part of a name in camel case; strings without digits whose parts are four letters long on average are names.
_NAME_PART = re.compile(r"[A-Z][a-z]*|[a-z]+")
#: Code points of a candidate at least, and of the pieces in which the novelty of a longer one is measured.
SHORTEST, PIECE = 16, 512
#: Code points before and after a candidate that count as its surroundings, and on either side of a sensitive word.
AROUND, REACH = 400, 80
#: Marginal compressed bytes a byte of a candidate, from which it is reported, and the bytes it adds at least.
NOVELTY, LEAST_BYTES = 0.72, 14
#: Identifiers and phrases of code and configuration that a string may be made of without being a secret.
IDENTIFIERS = " ".join(
    "public private protected static final class function return import export default const string integer boolean value values "
    "config configuration settings environment variable password passwd secret token access refresh api_key apiKey api-key client "
    "client_id client_secret username user_name account authorization bearer authentication credentials connection connectionString "
    "database host hostname localhost server service endpoint request response header headers content content-type application/json "
    "http https www example.com index.html version release package module manager controller handler factory provider repository "
    "builder context session cookie storage bucket region us-east-1 eu-west-1 production staging development test testing mock sample "
    "placeholder changeme your_password_here your-api-key-here replace_me example_secret_value xxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000 "
    "1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ signature certificate private_key public_key "
    "getElementById addEventListener querySelector toString valueOf hashCode equals initialize implementation interface abstract "
    "exception error message warning information logging logger debug timestamp created_at updated_at identifier parameter argument".split()
)
_compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind; a span is the whole match."""
    found = []
    if _KEYWORDS.search(text):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that a candidate adds to its compressed surroundings, the compressor primed with the identifier dictionary."""
    around = before + "\n" + after + "\n"
    return len(_compressor.compress((around + candidate).encode())) - len(_compressor.compress(around.encode()))


def _surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """AROUND code points before and after a candidate, free of its own copies, those across the far edges too."""
    one, wide = text[start:end], AROUND + end - start
    before, after = (x.replace(one, "\n") for x in (text[max(0, start - wide) : start], text[end : end + wide]))
    return before[-AROUND:], after[:AROUND]


def _values(text: str, start: int, end: int, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What a part holds besides the keys around its sensitive words; a separator next to a key belongs to neither."""
    out, at = [], start
    for a, b in words:
        out.append((at, a - 1 if a > at and text[a - 1] in "_-" else a))
        key = _KEY_END.match(text, b, end)
        at = key.end() if key else b
    return [*out, (at, end)]


def _merged(taken: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, both ascending."""
    starts, ends = [], []
    for a, b, _ in sorted(taken):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Strings in reach of a sensitive word that hardly compress given code identifiers and their surroundings.

    In a run like KEY=VALUE or KEY_VALUE the value is judged; where no value is reported, the whole part between '=' is,
    and the whole run if all its parts are too short. Candidates may be of any length; one above PIECE is reported whole when one of its pieces is
    novel. Spans that overlap a base span, strings without digits all in capitals or whose parts by capitals, '_' and '-' are as long as
    those of names, and what the compressor knows are left out.
    """
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken_starts, taken_ends = _merged(taken)

    def novel(start: int, end: int) -> bool:
        first, last = bisect.bisect_left(ends, start - REACH), bisect.bisect_right(starts, end + REACH) - 1
        # a word within the candidate does not count
        if end - start < SHORTEST or first > last or starts[first] >= start and ends[last] <= end:
            return False
        if bisect.bisect_right(taken_ends, start) < bisect.bisect_left(taken_starts, end):
            return False
        one = text[start:end]
        if not any(c.isdigit() for c in one) and (one.isupper() or len(one) >= 4 * len(_NAME_PART.findall(one))):
            return False
        around = _surroundings(text, start, end)
        size = -(-len(one) // -(-len(one) // PIECE))
        pieces = (one[i : i + size] for i in range(0, len(one), size))
        return any(marginal_bytes(x, *around) >= max(LEAST_BYTES, NOVELTY * len(x)) for x in pieces)

    def first_novel(*levels: list[tuple[int, int]]) -> list[tuple[int, int]]:
        for i, level in enumerate(levels):
            if level not in levels[:i] and (found := [x for x in level if novel(*x)]):
                return found
        return []

    out = []
    for run in _RUN.finditer(text):
        if bisect.bisect_left(ends, run.start() - REACH) == bisect.bisect_right(starts, run.end() + REACH):
            continue
        parts, found = [m.span() for m in _PART.finditer(text, *run.span())], []
        for a, b in parts:
            held = words[bisect.bisect_left(starts, a) : bisect.bisect_right(ends, b)]
            found += first_novel(_values(text, a, b, held), [(a, b)])
        out += found or (first_novel([run.span()]) if all(b - a < SHORTEST for a, b in parts) else [])
    return [(a, b, "novel") for a, b in out]


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then by kind in the order of KINDS."""
    base = base_spans(text)
    return sorted(base + (novel_spans(text, base) if _SENSITIVE.search(text) else []), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str) -> str:
    """text with every span replaced by <kind>; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for text in batch.column(1):
            found = spans(text.as_py())
            base = [x for x in found if x[2] != "novel"]
            row = [*(sum(x[2] == k for x in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)]
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)


def scan(docs: DataFrame) -> DataFrame:
    """One row for every row of documents(doc_id, text): counts of base spans, the hash of their list, and all spans.

    Offsets are code points, ends exclusive. Null texts count as empty; repeated rows each get a row, in no given order;
    an empty table gives none; other columns are not read. Each document is scanned alone, so nothing is shuffled.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(given_back(_scanned), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if x.as_py() is None else redacted(x.as_py()) for x in batch.column(at)]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """documents with every span of its texts replaced by its kind in angle brackets; all other columns stay, whatever their names.

    Each row is judged alone, so repeated rows and rows with one doc_id get what their own texts give. Null and empty texts
    stay as they are; doc_id is not read. An empty table gives an empty one. Texts of any length are taken whole.
    """
    return docs.mapInArrow(given_back(_redacting), docs.schema)
