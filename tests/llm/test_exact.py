"""Operators against plain versions where the first tests only held bounds, rows told apart by more than doc_id, and clashing names."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.llm import common, components, minhash, mixing, quality, queries, rules, secrets, sharding, simhash, suffixes

from . import brute
from .test_operators import EDGES, SCHEMA, SF, novel, rows_of, same

NAMES = ["fp", "H", "n", "id__", "hash__", "place__", "stay_id__", "mark__", "row__", "made__", "doc__", "source__", "found__", "host", "path", "no_host", "no_path", "evidence", "site_prior", "size", "repeats", "before", "passes", "blocks", "full", "start", "copies", "copy", "kept", "row", "base"]


@pytest.fixture(scope="module")
def odd(spark):
    """EDGES, doc_ids with two texts, and every name that the stages use inside."""
    more = [(4, "two", "en", "b", 3), (6, "another text under a doc_id that is there already", "en", "c", 1), (None, "one", "en", "a", 1)]
    return spark.createDataFrame(EDGES + more, SCHEMA).withColumns({n: F.lit(i) for i, n in enumerate(NAMES)}).repartition(3)


def texts(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(str(rng.randrange(10**5)) for _ in range(words)) for _ in range(n)]


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 40}") for i in range(300)]
    counts = Counter(k for _, k in rows)
    table = [(k, n, f"v{k}") for k, n in counts.items() if k != "k3"]
    left, right = spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(table, "k string, n long, v string")
    expected = [(i, k, None if k == "k3" else f"v{k}") for i, k in rows]
    for most in (10_000, 4):
        monkeypatch.setattr(common, "MOST_HOT", most)
        same([tuple(r) for r in common.join_counted(left, right, ["k"], "n").collect()], expected)


def test_pivot_tables_discard_pairs_and_keep_links():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 4000, np.uint64)
    far = rng.integers(0, 2**64, 4000, np.uint64)
    near = a.copy()
    for _ in range(simhash.RADIUS):
        near ^= np.uint64(1) << rng.integers(0, 64, 4000, np.uint64)
    assert simhash.survivors(simhash.distances(a), simhash.distances(near), simhash.RADIUS).all()
    assert simhash.survivors(simhash.distances(a), simhash.distances(far), simhash.RADIUS).mean() < 0.001
    assert (simhash._of_two(np.stack([a, near], axis=1), 3) == np.stack([a, near], axis=1)).all() and len(simhash._of_two(np.stack([a, far], axis=1), 3)) == 0


def test_large_buckets_meet_in_cells_of_pivot_distances(spark, monkeypatch):
    rng = random.Random(3)
    marks = sorted({rng.getrandbits(8) | rng.getrandbits(4) << 60 for _ in range(900)})
    names = brute.components(list(enumerate(marks)))
    monkeypatch.setattr(simhash, "BUCKET", 9)
    links = simhash.fingerprint_links(spark.createDataFrame([(simhash._signed(x),) for x in marks], "fp long"))
    found = {r.node % 2**64: r.root for r in components.connected_components(links).collect()}
    groups = Counter(names.values())
    assert {x for x in marks if groups[names[x]] > 1} == set(found)
    assert len({(names[x], found[x]) for x in found}) == len({names[x] for x in found}) == len(set(found.values()))


def test_wide_links_are_verified(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for i, t in enumerate(texts(150, 150, 4)):
        words = t.split()
        for _ in range(2):
            words[rng.randrange(150)] = "x"
        rows += [(i, t), (1000 + i, " ".join(words))]
        if brute.jaccard(t, rows[-1][1]) >= 0.8:
            pairs.append((i, (brute.simhash(t) ^ brute.simhash(rows[-1][1])).bit_count()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash._rooted(docs, wide=True).collect()}
    assert all(found[1000 + i] in (i, 1000 + i) for i in range(150))
    joined = lambda hs: [found[1000 + i] == i for i, h in pairs if h in hs]
    assert all(joined(range(6))) and not any(joined(range(simhash.WIDE + 1, 65)))
    near = joined(range(4, simhash.WIDE + 1))
    assert len(near) > 60 and sum(near) >= 0.75 * len(near)
    kept = [r.doc_id for r in simhash.one_of_each(docs, wide=True).collect()]
    assert sorted(kept) == sorted(set(found.values()))


def test_wide_links_in_chunks_are_a_forest(spark, monkeypatch):
    """Many near copies of one text: chunks change no component, and components hold every similar pair of up to 5 bits."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = texts(1, 150, 6)[0].split()
        for _ in range(rng.choice((1, 2))):
            words[rng.randrange(150)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: r.component_id for r in simhash._rooted(docs, wide=True).collect()}]
    monkeypatch.setattr(simhash, "HELD", 60_000)
    monkeypatch.setattr(simhash, "BUCKET", 16)
    found.append({r.doc_id: r.component_id for r in simhash._rooted(docs, wide=True).collect()})
    assert found[0] == found[1]
    narrow = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(set(found[0].values())) < len(set(narrow.values()))
    marks = {i: brute.simhash(t) for i, t in rows}
    for (i, t), (j, u) in combinations(rows[:120], 2):
        if (marks[i] ^ marks[j]).bit_count() <= 5 and brute.jaccard(t, u) >= 0.8:
            assert found[0][i] == found[0][j]
    assert all(found[0][i] == found[0][x] for i, x in narrow.items())


def test_first_masks():
    rng = random.Random(4)
    masks = simhash._masks(simhash.WIDE_BLOCKS, simhash.WIDE_AGREE)
    apart = [rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(2000)] + [0, 2**64 - 1]
    plain = [next((i for i, m in enumerate(masks) if x & m == 0), -1) for x in apart]
    assert simhash.first_masks(np.array(apart, np.uint64)).tolist() == plain


def test_stages_keep_names_and_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (6, 1), (9, 0), (11, 1)], "doc_id long, quality int")
    for found in (simhash.one_of_each(odd, wide=True), quality.kept_documents(odd, labels), mixing.mixed(odd), secrets.redact(odd)):
        assert found.columns == odd.columns
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in found.collect())
    kept = Counter((r.doc_id, r.text) for r in simhash.one_of_each(odd, wide=True).collect())
    # copies of "one" under 3, 4 and no doc_id; doc 4 keeps its other text
    assert kept[3, "one"] == 1 and kept[4, "one"] == 0 and kept[4, "two"] == 1 and kept[None, "one"] == 1 and sum(n for (d, t), n in kept.items() if d == 6) == 2


def test_quality_judges_rows_not_ids(spark):
    good, junk = "good words here and there for all to read " * 5, "### $$$ %%% " * 20
    rows = [(i, f"{good} {i}", "en", "a") for i in range(60)] + [(100 + i, f"{junk} {i}", "en", "a") for i in range(60)]
    labels = spark.createDataFrame([x for i in range(60) if i != 7 for x in ((i, 1), (100 + i, 0))], "doc_id long, quality int")
    rows += [(7, junk, "en", "a"), (107, good, "en", "a"), (None, junk, "en", "a"), (None, good, "en", "a"), (500, junk, None, None), (501, good, None, None), (501, good, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = quality.kept_documents(docs, labels).collect()
    same([tuple(r) for r in kept], [r for r in rows if r[1].startswith("good")])


def test_sites_change_verdicts_and_match_plain_posteriors(spark, monkeypatch):
    rng = random.Random(2)
    good, junk = ["calm", "river", "garden", "letter"], ["click", "winner", "casino", "bonus"]
    say = lambda share: " ".join(rng.choice(good if rng.random() < share else junk) for _ in range(40))
    rows = [(i, say(0.85), "en", "fine") for i in range(300)] + [(1000 + i, say(0.15), "en", "foul") for i in range(300)]
    labels = [(i, 1) for i in range(150)] + [(1000 + i, 0) for i in range(150)]
    mixed = " ".join((good + junk) * 5)
    rows += [(5000, mixed, "en", "fine"), (5001, mixed, "en", "foul"), (5002, mixed, "de", "foul"), (5003, mixed, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[5000].evidence == got[5001].evidence and got[5000].kept and not got[5001].kept and got[5001].score < got[5002].score
    p = {d: 1 / (1 + np.exp(-r.evidence)) for d, r in got.items()}
    whole = np.mean(list(p.values()))
    hosts, paths = {}, {}
    for d, _, lang, source in rows:
        hosts.setdefault(source, []).append(p[d])
        paths.setdefault((source, lang), []).append(p[d])

    def strength(sites):
        n = sum(len(v) for v, _ in sites)
        between = (sum(len(v) * (np.mean(v) - m) ** 2 for v, m in sites) - (len(sites) - 1) * whole * (1 - whole)) / n
        return min(1e4, max(2.0, whole * (1 - whole) / between - 1)) if between > 0 else 1e4

    k = strength([(v, whole) for v in hosts.values()])
    means = {h: (sum(v) + k * whole) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(v, means[h]) for (h, _), v in paths.items()])
    for d, _, lang, source in rows:
        prior = (sum(paths[source, lang]) + k * means[source]) / (len(paths[source, lang]) + k)
        odds = got[d].evidence + np.log(prior / (1 - prior)) - np.log(whole / (1 - whole))
        assert got[d].site_prior == pytest.approx(prior) and got[d].score == pytest.approx(1 / (1 + np.exp(-odds)))


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken): shards are walked word by word."""
    by = {}
    for d, t, s in rows:
        size = len(brute.WORDS.findall(t or ""))
        mark = brute.chained_hash(mixing.SEED, ("long", d), ("long", brute.chained_hash(t or "")))
        by.setdefault(s, []).append((mark, d is not None, d or 0, size, d))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[3] for x in by[s]) for s in sources]
    targets = mixing.capped_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    quotas = mixing.sainte_lague(targets, round(sum(sizes) / mixing.BLOCK))
    counts, out = mixing.shards_of(dict(zip(sources, sizes, strict=True))), []
    for s, size, target, quota in zip(sources, sizes, targets, quotas, strict=True):
        shards = {}
        for x in sorted(by[s]):
            shards.setdefault((x[0] >> 20) % counts[s], []).append(x)
        order = sorted(shards)
        plan = mixing.shard_plan([sum(x[3] for x in shards[i]) for i in order], quota)
        for i, (passes, blocks) in zip(order, plan, strict=True):
            full = sum(x[3] for x in shards[i]) // mixing.BLOCK
            start = brute.chained_hash(mixing.SEED, s, ("long", i)) % max(1, full)
            for x, taken in brute.words_of_shard([(x, x[3]) for x in shards[i]], passes, blocks, start):
                out.append((x[-1], x[3], size, target, taken))
    return out


@pytest.mark.parametrize("shard_words", [500_000, 300])
def test_mixing_takes_seeded_blocks(spark, odd, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(docs.where("doc_id % 9 = 0")).union(odd.select("doc_id", "text", "source"))
    rows = [tuple(r) for r in docs.collect()]
    expected = plain_mix(rows)
    same([tuple(r) for r in mixing.mix(docs).collect()], expected)
    assert len({t for *_, t in expected}) > 10 and any(0 < t < n for _, n, _, _, t in expected)
    copies = sum(-(-t // n) for _, n, _, _, t in expected if n)
    assert mixing.mixed(docs).count() == copies


def test_mixing_of_many_sources_equals_the_drivers(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 3, 3, 3, 8, 200]), None if i % 31 == 0 else f"s{rng.randrange(90)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    expected = mixing.mix(docs).collect()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    got = mixing.mix(docs).collect()
    key = lambda r: (r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
    same(map(key, got), map(key, expected))


@pytest.mark.parametrize("table", ["odd", "docs", "many"])
def test_sharding_interleaves_by_fractional_rank(spark, odd, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF if table == 'docs' else SF.replace('0.001', '0.01')}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    same([(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs).collect()], brute.interleaved(rows))
    assert sharding.cell_bits(1000) == 12 and 2 ** sharding.cell_bits(10**12) >= 10**12 / sharding.CELL_ROWS


def test_rules_compare_words_where_hashes_clash(spark, odd, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(100, "a b c d a b x a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hashed in ("xxhash64(x, w[i + 1], w[i + 2])", "cast(ascii(x) % 3 as bigint)", "0L"):
        monkeypatch.setattr(rules, "WINDOW_HASH", hashed)
        for df in (docs, odd):
            got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judged(df).collect()]
            same(got, [(d, *brute.rules(t)) for d, t in rows_of(df)])


def test_ablations_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    table = con.execute(queries.oracle_sql()["rule_ablations"]).to_arrow_table().to_pylist()
    same([sorted(r.asDict().items()) for r in queries.rule_ablations(spark, SF).collect()], [sorted(r.items()) for r in table])


def test_minhash_by_plain_integers(spark, odd):
    a, b = minhash._A.tolist(), minhash._B.tolist()
    plain = lambda t: brute.minhash(t, minhash.PERMUTATIONS, a, b, minhash._BASE, int(minhash._MIX), [int(x) for x in minhash._ORDER])
    docs = odd.where("length(text) < 1500 or text is null")
    marks = {t or "": plain(t or "") for _, t in rows_of(docs)}
    assert all(r.fingerprint == marks[t] for r, t in ((r, t) for r in minhash.successor_fingerprints(docs).collect() for t in marks if len(t) == r.n_chars and list(map(len, marks)).count(len(t)) == 1))
    for t in marks:
        assert minhash.signatures([t.encode()])[0].tobytes().hex() == marks[t]


def test_minhash_recall_at_the_threshold(spark):
    rng, rows, linked = random.Random(7), [], set()
    for i, t in enumerate(texts(300, 204, 8)):
        words = t.split()
        words[:22] = [str(rng.random()) for _ in range(rng.randrange(14, 23))] + words[22:22]
        rows += [(i, t), (1000 + i, " ".join(words))]
        if brute.jaccard(t, rows[-1][1]) >= 0.8:
            linked.add((i, 1000 + i))
    assert min(brute.jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i, _ in linked) < 0.82 and len(linked) > 100
    got = {(r.a, r.b) for r in minhash.near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= linked and len(got) >= 0.99 * len(linked)


def test_secrets_recall_and_precision():
    """Of planted secrets and of identifiers in the same places. Without digits, all of one case: none is found, as the README says."""
    rng = random.Random(11)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    forms = ["passphrase: {}", "export PRIVATE_KEY={}", "credential = '{}'", "Authorization: Bearer {}", "{}  # access key", '"connection_string": "{}"']
    kinds = {"mixed with digits": (upper + lower + digits, 24, 1.0), "base64": (upper + lower + digits + "+/", 40, 1.0), "capitals with digits": (upper + "234567", 32, 0.9), "mixed letters": (upper + lower, 28, 0.97)}
    for kind, (letters, n, least) in kinds.items():
        hits = 0
        for i in range(240):
            key = "".join(rng.choice(letters) for _ in range(n))
            hits += novel(f"some words before\n{forms[i % 6].format(key)}\nand after") == [key] or bool(secrets._SENSITIVE.search(key))
        assert hits >= least * 240, (kind, hits)
    words = "get set user remote profile validate config handler session request response parse token build default value name list index page order total client server".split()
    wrong = 0
    for i in range(400):
        some = [rng.choice(words) for _ in range(rng.randrange(3, 6))]
        name = [("_".join(some)), "-".join(some), "".join(x.title() for x in some), some[0] + "".join(x.title() for x in some[1:])][i % 4]
        wrong += bool(novel(f"some words before\n{forms[i % 6].format(name)}\nand after"))
    assert wrong <= 0.03 * 400, wrong


def test_secrets_scan_long_texts_in_linear_time():
    import time

    text, began = "token=abcdefghijkl0123 bearer Zk81vTqa9XbQ7d2Wm4 " * 40_000, time.time()
    assert len(secrets.spans(text)) == 80_000 and time.time() - began < 60


@pytest.mark.parametrize("gap", [0, 40, 80])
def test_redaction_leaves_no_tail(gap):
    rng = random.Random(gap)
    for n in (513, 600, 10_000):
        key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrsuvwxyz23456789") for _ in range(n))
        assert secrets._SENSITIVE.search(key) or secrets.redacted(f"bearer{' ' * gap or ' '}{key}\n") == f"bearer{' ' * gap or ' '}<novel>\n"


def test_suffixes_of_long_texts_come_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(9000))
    whole = [(at.tolist(), h.tolist()) for _, _, h, _, at in suffixes._anchored([long.encode()])]
    monkeypatch.setattr(suffixes, "STRIDE", 700)
    pieces = [(at.tolist(), h.tolist()) for _, _, h, _, at in suffixes._anchored([long.encode()])]
    assert len(pieces) > 10 and ([x for a, _ in pieces for x in a], [x for _, h in pieces for x in h]) == whole[0]
    monkeypatch.undo()
    part = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, part + "x" * 3000), (2, part[1000:270_000] + "-" + part[260_000:]), (3, "x" * 280_000), (4, "xy" * 2000 + "x" * 900), (5, None), (5, part[:90]), (None, part), (5, "xyxyxy" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in suffixes.repeated_strings(docs).collect()], brute.repeated_strings(rows))


def test_suffixes_of_one_repeated_byte_stay_small():
    import tracemalloc

    text = b"x" * 2_000_000
    tracemalloc.start()
    grams = np.unique(np.concatenate([h for _, _, h, _, _ in suffixes._anchored([text])]))
    parts = list(suffixes._contexts([text], grams, np.zeros(len(grams), np.uint8), 4))
    assert sum(len(p[0]) for p in parts) < 2000 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_folders_must_be_named_on_a_cluster():
    class Context:
        master = "spark://x"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:  # noqa: N801
            @staticmethod
            def isEmpty():  # noqa: N802
                return True

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


def test_rounds_do_not_pile_up_shuffle_files(spark):
    """Once tables are cut, the shuffles that made them go from disk but for the last ones, without waiting for the driver's memory to fill."""
    import time

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    common.cut(spark.range(10))
    before, state = files(), spark.range(1000).selectExpr("id", "id % 50 AS k")
    for _ in range(8):
        state = common.cut(state.repartition(16, "k").repartition(16, "id"))
    time.sleep(3)
    assert files() - before < 120
