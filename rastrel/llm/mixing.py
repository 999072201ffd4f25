"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, fresh, join_counted, partitions, text_or_empty

SEED = 20_240_501
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
REPEATS = 3
#: Words of a block, and the fewest that a source is cut into more shards for.
BLOCK, SHARD_WORDS = 32, 500_000
#: Shards hold at least this part of all words, so there are at most twice as many, and one more for each source.
SHARDS = 20_000
#: Sources that the driver apportions; more are apportioned by aggregations, with the same seats.
MOST_SOURCES = 20_000


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), earlier parties first among equals.

    A divisor is searched that hands out no more than all seats by rounding; the few left go to the highest next quotients,
    so the cost doesn't grow with the number of seats.
    """
    if not votes or sum(votes) <= 0:
        return [0] * len(votes)
    low, high = sum(votes) / (seats + len(votes)) / 4, 2 * sum(votes) / max(seats, 1) * len(votes) + 1

    def given(divisor: float) -> list[int]:
        return [int(v / divisor + 0.5) for v in votes]

    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(given(middle)) > seats else (low, middle)
    out = given(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def capped_targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight, each at most `most` times its size, the excess shared anew by weight."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def shard_unit(total: int) -> int:
    """Words from which a source gets another shard; _shards of them, a power of two, by a source's words."""
    return max(SHARD_WORDS, total // SHARDS)


def shards_of(sizes: dict[str | None, int]) -> dict[str | None, int]:
    """Shards of each source, powers of two, by its words and the words of all."""
    unit = shard_unit(sum(sizes.values()))
    return {s: 1 << (n // unit).bit_length() for s, n in sizes.items()}


def shard_plan(words: list[int], quota: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """(whole passes, blocks of a last pass) of each shard of a source that takes quota blocks; no shard is passed more than REPEATS times.

    Blocks go to shards by the highest quotients. What a shard's whole blocks and passes leave of its part, half a block
    at most, is carried to the next shard.
    """
    out, carry = [], 0
    for w, n in zip(words, sainte_lague([float(w) for w in words], quota), strict=True):
        want = n * block + carry
        passes, rest = divmod(min(max(want, 0), REPEATS * w), w) if w else (0, 0)
        blocks = min((rest + block // 2) // block, w // block)
        if w - rest < abs(rest - blocks * block):
            passes, blocks = passes + 1, 0
        carry = want - passes * w - blocks * block
        out.append((passes, blocks))
    return out


def _position(df: DataFrame, *order) -> DataFrame:
    """df with position (from 0) in an order without ties, ranked within ranges, whose counts alone come together."""
    ranged = cut(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(before), "part").withColumn("position", F.col("before") + rank - 1).drop("part", "before")


def _many_quotas(sources: DataFrame, total: int, weights: tuple[int, ...], block: int) -> DataFrame:
    """sources(source, words) with target and quota, by aggregations: capped_targets and sainte_lague over any number of sources."""
    weight = F.array(*map(F.lit, weights))[F.pmod("position", F.lit(len(weights)))].cast("double")
    placed = cut(_position(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", weight))
    unit, most = None, REPEATS * F.col("words")
    while True:
        above = F.lit(False) if unit is None else unit * F.col("weight") > most
        row = placed.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (row[0] or 0)) / row[1] if row[1] else unit
        if new is None or unit is not None and new <= unit:
            break
        unit = new
    found = cut(placed.withColumn("target", F.when(unit * F.col("weight") > most, most.cast("double")).otherwise(unit * F.col("weight"))))
    seats, v = round(total / block), F.col("target")
    low, high = total / 4 / (seats + 1) / found.count(), 2 * total + 1.0
    given = lambda divisor: F.floor(v / divisor + 0.5)
    for _ in range(40):
        tries = [low * (high / low) ** (i / 32) for i in range(1, 32)]
        sums = found.agg(*(F.sum(given(x)) for x in tries)).first()
        enough = [x for x, n in zip(tries, sums, strict=True) if n <= seats]
        few = [x for x, n in zip(tries, sums, strict=True) if n > seats]
        if (few[-1] if few else low, enough[0] if enough else high) == (low, high):
            break
        low, high = few[-1] if few else low, enough[0] if enough else high
    found = cut(found.withColumn("quota", given(high)))
    left = seats - found.agg(F.sum("quota")).first()[0]
    ties = _position(found.where(given(low) > F.col("quota")).select("source", (v / (2 * F.col("quota") + 1)).alias("q"), F.col("position").alias("at")), F.col("q").desc(), F.col("at"))
    more = ties.where(F.col("position") < left).select(F.col("source").alias("s"), F.lit(1).alias("more"))
    return found.join(more, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "words", "n", "target", (F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))


_QUOTA = "source string, words long, n long, target double, quota long"


def _quotas(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """sources(source, words, n) with target and quota, the blocks that a source gives."""
    count, total = sources.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    if count > MOST_SOURCES:
        return cut(_many_quotas(sources, total, weights, block))
    rows = sorted((tuple(r) for r in sources.select("source", "words", "n").collect()), key=lambda r: (r[0] is None, r[0] or ""))
    targets = capped_targets([r[1] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    return sources.sparkSession.createDataFrame([(*r, t, q) for r, t, q in zip(rows, targets, sainte_lague(targets, round(total / block)), strict=True)], _QUOTA)


_PLAN = "source string, shard long, passes long, blocks long, full long, n long"


def _planned(batches: Iterable[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, quota, shards in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            takes = shard_plan([x["words"] for x in shards], quota, block)
            out += [(source, x["shard"], p, b, x["words"] // block, x["n"]) for x, (p, b) in zip(shards, takes, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(6)], [x.split()[0] for x in _PLAN.split(", ")])


def _mark() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64(text_or_empty()))


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size, repeats): rows that are equal in doc_id, source and text are one group."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _mark().alias("mark"), _size().alias("size")).groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("repeats"))


def _placed(docs: DataFrame) -> DataFrame:
    """_groups with words (of the source), target, before (words ahead in the shard) and the shard's passes, blocks, full (blocks) and start."""
    groups = cut(_groups(docs))
    sources = cut(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("words"), F.count("*").alias("n")))
    quotas = _quotas(sources)
    unit = shard_unit(sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    shards = quotas.withColumn("shards", F.expr(f"shiftleft(1L, length(bin(words div {unit})) - if(words < {unit}, 1, 0))"))
    rows = join_counted(groups, shards.select("source", "words", "target", "shards", "n"), ["source"], "n")
    rows = rows.withColumn("shard", F.pmod(F.shiftright("mark", 20), "shards")).drop("shards")
    sums = rows.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("repeats")).alias("words"), F.count("*").alias("n"))
    lists = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "words", "n"))).alias("shards"))
    plan = lists.join(quotas.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s"))).select("source", "quota", "shards").mapInArrow(_planned, _PLAN)
    start = F.pmod(F.xxhash64(F.lit(SEED), "source", "shard"), F.greatest("full", F.lit(1).cast("long")))
    rows = join_counted(rows, cut(plan.withColumn("start", start)), ["source", "shard"], "n")
    order = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("repeats")).over(order), F.lit(0)))


def _taken(row: str) -> Column:
    """Words taken of the row-th (from 0) of a group's repeats: those of the passes and of the chosen blocks that it meets.

    Of a shard's `full` blocks `blocks` are chosen, those from the seeded start on, and after the last the first. So all but two of the
    documents, which stand in seeded order, are chosen whole or not at all.
    """
    chosen = lambda i: f"(greatest(0L, least({i}, start + blocks) - start) + greatest(0L, least({i}, start + blocks - full)))"
    upto = lambda x: f"(passes * {x} + {BLOCK} * {chosen(f'({x} div {BLOCK})')} + if({x} div {BLOCK} < full, {chosen(f'({x} div {BLOCK} + 1)')} - {chosen(f'({x} div {BLOCK})')}, 0) * ({x} % {BLOCK}))"
    at = f"(before + {row} * size)"
    return F.expr(f"{upto(f'({at} + size)')} - {upto(at)}").cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of documents(doc_id, text, source).

    Sources share all words by WEIGHTS, none above REPEATS times its size. The sum of words makes equal blocks, which go
    to the sources by the highest quotients and, within a source, to its shards, into which documents fall by a seeded hash,
    so a source that holds most rows is spread over shards in proportion to its words. A shard's documents stand in seeded
    order and its words are cut into blocks there: each block is taken as often as there are whole passes, and the rest of the
    quota once more from blocks chosen from a seeded start. Sources in any number are apportioned, by the driver up to
    MOST_SOURCES, which holds no more rows than that.

    Null texts have size 0 and are never taken; a null source is a source, the last one. Rows that repeat doc_id, source and
    text move as one group and each get a row. An empty table gives none. A tie in the seeded order goes by doc_id, then
    size. Other columns are not read.
    """
    rows = _placed(docs).withColumn("base", F.explode(F.expr("sequence(0L, repeats - 1, 65536L)")))
    rows = rows.withColumn("row", F.explode(F.expr("sequence(base, least(base + 65536, repeats) - 1)")))
    return rows.select("doc_id", "size", F.col("words").alias("source_size"), "target", _taken("row").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """documents as the mixture takes them: each row as often as its taken words make passes through it, a last one begun counting whole.

    All columns stay as they are, whatever their names; rows of which no word is taken go, so null and empty texts do. Rows
    that repeat doc_id, source and text are numbered by a hash of the other columns, and each comes as often as mix
    takes that number. Null doc_ids and sources are values like any other. An empty table gives an empty one.
    """
    found = cut(_placed(docs).where("size > 0 and (passes > 0 or blocks > 0)").select("doc_id", "source", "mark", "size", "repeats", "before", "passes", "blocks", "full", "start"))
    mark, row, made, *keys = fresh(docs, "mark__", "row__", "made__", "doc__", "source__", "found__")
    info = found.select(F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("mark").alias(keys[2]), F.struct("size", "repeats", "before", "passes", "blocks", "full", "start").alias(made))
    # the mark stands for doc_id and text; joining on it spreads what one doc_id may repeat
    met = docs.withColumn(mark, _mark()).join(info, (F.col(mark) == F.col(keys[2])) & F.col("doc_id").cast("long").eqNullSafe(F.col(keys[0])) & F.col("source").cast("string").eqNullSafe(F.col(keys[1])))
    others = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    number = F.row_number().over(Window.partitionBy(mark, keys[0], keys[1]).orderBy(F.xxhash64(*others))) - 1
    every = met.where(F.col(made)["repeats"] == 1).withColumn(row, F.lit(0))
    if found.where("repeats > 1").limit(1).count():
        every = every.union(met.where(F.col(made)["repeats"] > 1).withColumn(row, number))
    every = every.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), F.col(row).alias("row"), f"{made}.*")
    return every.withColumn("copies", F.ceil(_taken("row") / F.col("size")).cast("int")).where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("kept.*")
