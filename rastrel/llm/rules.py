"""Quality rules as a ledger: every rule once, failures as bits, policies and ablations over the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAKS, WORD, text_or_empty

#: Rules by bit, each a condition over the measurements that is true where it fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 5 * n_words",
    "repeated_lines": "n_dup_lines > 0 and 100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
    "capitals": "100 * n_capitals > 25 * word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the bits that reject a document.
POLICIES = {"base": BITS["few_words"] | BITS["repeated_words"], "v1": sum(BITS[x] for x in ("few_words", "repeated_words", "symbols")), "v2": sum(BITS.values())}
POLICY = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


#: The hash of the 3-word window that starts at word x, the i-th of w.
WINDOW_HASH = "xxhash64(x, w[i + 1], w[i + 2])"


def _covered(places: str) -> str:
    """Words that 3-word windows at the given places, ascending, cover: 3 each, less where the next one starts earlier."""
    return f"aggregate(transform(array({places}), p -> aggregate(transform(p, (x, i) -> least(3L, coalesce(get(p, i + 1) - x, 3L))), 0L, (a, x) -> a + x)), 0L, (a, x) -> a + x)"


def _repeat_words(s: str, bits: str) -> Column:
    """Words in 3-word windows that occur twice or more, from s, the sorted longs of each window's hash and place.

    The low `bits` bits of a long are the place. Windows that share their hash with a neighbour in order are repeated if all such
    neighbours are the same three words, which is checked; a text where some differ has its windows sorted by their words.
    """
    place = lambda x: f"cast({x} & (shiftleft(1L, {bits}) - 1) as int)"
    alike = lambda x, y: f"coalesce(shiftright({x}, {bits}) = shiftright({y}, {bits}), false)"
    after, before = f"get({s}, i + 1)", f"get({s}, i - 1)"
    differ = " or ".join(f"w[{place('x')} + {k}] <> w[{place(after)} + {k}]" for k in range(3))
    clash = f"exists(transform({s}, (x, i) -> {alike(after, 'x')} and ({differ})), x -> x)"
    fast = f"sort_array(transform(filter({s}, (x, i) -> {alike(before, 'x')} or {alike(after, 'x')}), x -> cast({place('x')} as bigint)))"
    rows = "array_sort(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(concat_ws(' ', x, w[i + 1], w[i + 2]) as t, cast(i as bigint) as at)))"
    again = "filter(r, (x, i) -> coalesce(get(r, i - 1).t = x.t, false) or coalesce(get(r, i + 1).t = x.t, false))"
    exact = f"sort_array(flatten(transform(array({rows}), r -> transform({again}, x -> x.at))))"
    return F.expr(f"case when {clash} then {_covered(exact)} else {_covered(fast)} end")


def _once(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """df with kept columns and the made ones, each computed once however often and wherever later steps read or filter by it.

    The one-row generator stops the optimizer from copying the expressions into later projections, lambdas and filters.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of every row of documents, by built-in functions alone."""
    breaks = "[" + "".join(f"\\x{ord(c):02x}" for c in BREAKS) + "]+"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = _once(
        text,
        ["doc_id"],
        w=F.when(F.col("text").rlike(WORD), F.split(F.btrim("text", F.lit(BREAKS)), breaks)).otherwise(F.array().cast("array<string>")),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
        n_symbols=F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        n_capitals=F.regexp_count("text", F.lit("\\p{Lu}")).cast("long"),
    )
    sized = _once(
        parts,
        ["doc_id", "w", "n_symbols", "n_capitals"],
        n_words=F.size("w").cast("long"),
        word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        bits=F.greatest(F.lit(1), F.length(F.bin(F.size("w").cast("long")))),
    )
    counted = [c for c in sized.columns if c != "w"]
    hashes = f"transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> (shiftleft({WINDOW_HASH}, coalesce(bits, 1)) | cast(i as bigint)))"
    sorted_ = _once(sized, [*counted, "w"], s=F.expr(f"sort_array({hashes})"))
    return _once(sorted_, [c for c in counted if c != "bits"], n_repeat_words=_repeat_words("s", "bits"))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failures) of every row: failures holds a bit for each rule that the row fails.

    Null texts count as empty: no words, no lines. Repeated rows each get a row; an empty table gives none; other columns
    are not read. Nothing is shuffled, and a row's work grows with its own text alone (n log n for the windows, which are
    sorted by hashes and compared by their words).
    """
    failures = F.lit(0)
    for name, rule in RULES.items():
        failures = failures.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)))
    measured = measure(docs)
    return _once(measured, measured.columns, failures=failures)


def passes(policy: str = POLICY, failures: str = "failures") -> Column:
    """Whether a row fails none of a policy's rules."""
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(ledgered: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it. One pass over the bits."""
    mask = POLICIES[policy]
    patterns = ledgered.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BITS.items() if bit & mask)))
    sums = patterns.withColumn("r", rules).groupBy("r.rule", "r.bit")
    own = F.col("f").bitwiseAND(F.col("r.bit"))
    return sums.agg(
        F.sum(F.when(own != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((own != 0) & (F.col("f") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("f") == own, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("f").alias("seen"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """The ledger with base_failed and kept: false where a base rule fails, else the verdict of POLICY."""
    base = ~passes("base")
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(POLICY)})
