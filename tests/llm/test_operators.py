"""Every operator against brute force on one small, nasty table; nulls, ties, repeats, long texts, clashing columns, empty tables."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from termwright.llm import byte_bpe, elias_fano, exact_dedup, lm, packing, quality, queries, recompression, repeats, simhash, suffix_dedup, toxicity, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i} passage" for i in range(40))
BASE = " ".join(f"word{i % 97} tail{i % 31}" for i in range(400))
ROWS = [
    (5, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One  Two"), (6, BASE), (7, BASE), (7, BASE), (8, BASE.replace(" ", "\n", 3)), (9, BASE + " end"), (10, "x " + PASSAGE + " y"),
    (11, PASSAGE), (12, "other start " * 30 + PASSAGE[:300] + " ü–ß 漢字 tail"), (13, "spam " * 400), (14, "spam " * 390 + "eggs"), (15, "ü" * 200), (16, "ä" + "ü" * 199), (17, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2),
    (18, "line of words here today\n" * 40), (19, "#$% what *** is & this | thing <> " * 20), (20, " ".join(f"unique{i}" for i in range(30))), (None, BASE), (None, "null id " * 20), (21, "z" * 30000 + " " + PASSAGE), (22, "1" * 60 + "\x1c\x85 x’s don't 123456"),
    (23, "hello <|endoftext|> x<|startoftext|>"), ((1 << 63) - 1, "largest id " * 20), (None, "largest id " * 20),
]
SCHEMA = "doc_id long, text string, h long, fp string, part int, key int, kept string, row string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "a", 2, 3, "k", "r", 4) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def b(t):
    return (t or "").encode()


def rank(i):
    return (1 << 63) - 1 if i is None else i


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def removal(cut, width):
    """Coverage of each row by windows that also start in a smaller document."""
    least = {}
    for i, t in ROWS:
        x = cut(t)
        for p in range(len(x) - width + 1):
            k = x[p : p + width] if isinstance(x, bytes) else tuple(x[p : p + width])
            least[k] = min(least.get(k, math.inf), rank(i))
    for i, t in ROWS:
        x = cut(t)
        gone = [False] * len(x)
        for p in range(len(x) - width + 1):
            if least[x[p : p + width] if isinstance(x, bytes) else tuple(x[p : p + width])] < rank(i):
                gone[p : p + width] = [True] * width
        yield i, x, gone


def op1_wanted():
    return sorted([(i, len(x), sum(g), hashlib.sha256(b" ".join(w for w, y in zip(x, g) if not y)).hexdigest()) for i, x, g in removal(lambda t: WORD.findall(b(t)), 13)], key=repr)


def test_op1(docs, empty):
    assert collect(recompression.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == op1_wanted()
    assert recompression.remove_repeats(empty).count() == 0


def test_op1_settles_windows_whose_hashes_collide(docs):
    got = recompression.remove_repeats(docs, hash_bits=4, block_bytes=3000)
    assert collect(got, "doc_id", "n_words", "n_removed", "kept_sha256") == op1_wanted()


def thue_morse():
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart_by_their_bytes(spark):
    # polynomial hashes modulo a power of two can't tell these two words apart
    one, two = thue_morse()
    twelve = " ".join(f"w{i}" for i in range(12))
    held = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(1, f"{twelve} {one}"), (2, f"{twelve} {two}"), (held, two + "x")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs).collect()} == {1: 0, 2: 0, held: 0}
    trained = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = spark.createDataFrame([(trained, one), (held, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.lm_scores(docs).collect()}[held] == 1


def test_levels_agree_inside_equal_windows():
    rng = np.random.default_rng(2)
    inner = rng.integers(1, 4, 13).astype(np.uint64)
    seen = set()
    for _ in range(60):
        left, right = rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint64), rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint64)
        name = np.concatenate([left, inner, right])
        at, ends, p = np.arange(len(name)), np.array([len(name)]), len(left)
        symbols = recompression.Symbols(name, at, at + 1, at == 0)
        found = []
        for level in (1, 2, 3):
            symbols, a, c = recompression.combine(symbols, level, 13)
            fresh = a > 0
            symbols.name = np.where(fresh, recompression.mix(a * np.uint64(3) + c), symbols.name)
            inside = (symbols.lo >= p) & (symbols.hi <= p + 13)
            found.append(tuple(zip((symbols.lo[inside] - p).tolist(), (symbols.hi[inside] - p).tolist(), symbols.name[inside].tolist())))
        seen.add(tuple(found))
    assert len(seen) == 1 and seen.pop()[0]


def test_op7(docs, empty):
    want = [(i, len(x), sum(g), sum(y and not z for y, z in zip(g, [False, *g])), hashlib.sha256(bytes(c for c, y in zip(x, g) if not y)).hexdigest()) for i, x, g in removal(b, 50)]
    got = suffix_dedup.remove_repeats(docs, carry=["h", "row"])
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert got.select("carry.row").distinct().count() == 1 and suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("way", ["collisions", "hot anchors", "parts"])
def test_op7_by_its_other_ways(docs, monkeypatch, way):
    bits = None
    if way == "collisions":  # found by comparing bytes, and run again
        bits = 2
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    if way == "hot anchors":
        monkeypatch.setattr(repeats, "HOT_BLOCKS", 2)
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    if way == "parts":  # the seam between stretches that are hashed apart
        monkeypatch.setattr(suffix_dedup, "PART", 700)
    want = [(i, sum(g), hashlib.sha256(bytes(c for c, y in zip(x, g) if not y)).hexdigest()) for i, x, g in removal(b, 50)]
    assert collect(suffix_dedup.remove_repeats(docs, hash_bits=bits), "doc_id", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_op7_keys_are_hot_by_their_windows(docs, monkeypatch):
    key = np.arange(1, 4, dtype=np.uint64) << np.uint64(62)
    asked = [[repeats.steps(key >> repeats.SHORT), repeats.planes(np.array([1, 200, 1], np.uint16))]] * 100
    told = repeats.own_keys(list(range(100)), asked, 0, repeats.HOT_BLOCKS, repeats.HOT_ITEMS)
    assert all(repeats.unbits(parts[1], 3).tolist() == [False, True, False] for _, _, parts in told)
    monkeypatch.setattr(repeats, "HOT_BLOCKS", 2)
    monkeypatch.setattr(repeats, "HOT_ITEMS", 1)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    want = [(i, sum(g), hashlib.sha256(bytes(c for c, y in zip(x, g) if not y)).hexdigest()) for i, x, g in removal(b, 50)]
    assert collect(suffix_dedup.remove_repeats(docs), "doc_id", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_op1_symbols_are_combined_in_bounded_parts(monkeypatch):
    """As in one go, and with no array beside those of the result that is as long as the block."""
    rng = np.random.default_rng(5)
    n = 200_000
    flags, gap = rng.random(n) < 0.9, rng.random(n) < 0.01
    gap[0] = True
    lo = np.arange(n)
    s, alive = recompression.Symbols(rng.integers(1, 40, n).astype(np.uint64), lo, lo + 1, gap), recompression.Alive(flags, 13)
    new, a, b = recompression.combine(s, 1, 13)
    keep = alive.around(new.lo, new.hi)
    want = new.pick(keep)
    for combined in (1 << 20, 1 << 12, 7):
        monkeypatch.setattr(recompression, "COMBINED", combined)
        got, a2, b2 = recompression.combine_fitting(s, 1, alive)
        for x, y in ((got.name, want.name), (got.lo, want.lo), (got.hi, want.hi), (got.gap, want.gap), (a2, a[keep]), (b2, b[keep])):
            assert np.array_equal(x, y)
        assert np.array_equal(alive.words(), alive.around(lo, lo + 1))
    monkeypatch.setattr(recompression, "COMBINED", 1 << 12)
    tracemalloc.start()
    recompression.Level(s, alive, np.zeros(n, np.int64), 1, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n  # in one go: 142 bytes a symbol


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 700)
    group = np.sort(rng.integers(0, 5, 700))
    order = suffix_dedup.suffix_sort(buf, starts, group, 50, suffix_dedup.Powers())
    raw = buf.tobytes()
    assert [(int(group[i]), raw[starts[i] : starts[i] + 50]) for i in order] == sorted((int(g), raw[s : s + 50]) for g, s in zip(group, starts))


def test_op2(docs, empty):
    fps = []
    for i, t in ROWS:
        w = [x.lower() for x in WORD.findall(b(t))]
        s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h)))
    boss = list(range(len(ROWS)))

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for x in range(len(ROWS)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 2 or ROWS[x][0] is not None and ROWS[x][0] == ROWS[y][0]:
                boss[root(x)] = root(y)
    least = collections.defaultdict(lambda: math.inf)
    for x, (i, _) in enumerate(ROWS):
        least[root(x)] = min(least[root(x)], math.inf if i is None else i)
    want = [(i, f"{fps[x]:016x}", None if least[root(x)] == math.inf else least[root(x)]) for x, (i, _) in enumerate(ROWS)]
    assert collect(simhash.near_dedup(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_dedup(empty).count() == 0
    assert set(simhash.near_filter(docs).columns) == set(docs.columns)


def test_near_filter_keeps_rows_of_null_and_repeated_ids(spark):
    a, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in ("left", "mid", "right"))
    # near: one space more is the same fingerprint; (None, a) and (None, c) tie nothing; doc 7 has two texts and so ties those of 8 and 9
    rows = [(5, a), (None, a + " "), (9, c), (None, c + " "), (None, "alone " * 30), (None, "alone too " * 30), (7, d), (7, "second text of seven " * 9), (8, d + " "), (10, " second text of seven" * 9), (11, "of its own " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [r for r in rows if r not in [(None, a + " "), (None, c + " "), (8, d + " "), (10, " second text of seven" * 9)]]
    assert collect(simhash.near_filter(docs), "doc_id", "text") == sorted(want, key=repr)
    ids = {r.doc_id: r.component_id for r in simhash.near_dedup(docs).collect() if r.doc_id is not None}
    assert ids == {5: 5, 9: 9, 7: 7, 8: 7, 10: 7, 11: 11}


def test_a_repeated_id_ties_classes_with_smaller_ids(spark):
    d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in ("right", "far"))
    # each text of doc 7 has a copy with a smaller id, so neither is 7's own class
    docs = spark.createDataFrame([(7, d), (7, e), (2, d + " "), (3, e + " ")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_dedup(docs).collect()} == {2}
    assert collect(simhash.near_filter(docs), "doc_id", "text") == [(2, d + " ")]


def test_near_stage_finds_pairs_of_jaccard_080(spark):
    import corpus_pipeline as c

    rng = np.random.default_rng(8)

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rows = [(None, "null one " * 30), (None, "two of null " * 30), (9000, "nine thousand " * 30), (9000, "a second text " * 30)]
    wanted = 0
    for i in range(150):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        v = list(w)
        for at in rng.choice(200, i % 8 + 1, False):
            v[at] = "other"
        rows += [(2 * i, " ".join(w)), (None if i % 10 == 0 else 2 * i + 1, " ".join(v))]
        wanted += len(grams(rows[-1][1]) & grams(rows[-2][1])) >= 0.8 * len(grams(rows[-1][1]) | grams(rows[-2][1]))
    got = {(r.doc_id, r.text) for r in c.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    gone = [i for i in range(4, len(rows)) if rows[i] not in got]
    for i in gone:  # only copies go, and only verified ones
        x, y = grams(rows[i][1]), grams(rows[i - 1][1])
        assert i % 2 and len(x & y) >= 0.8 * len(x | y)
    assert set(rows[:4]) <= got and wanted > 50 and len(gone) >= 0.9 * wanted


def groups(nodes, links):
    boss = {x: x for x in nodes}

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for x, y in links:
        boss[root(x)] = root(y)
    out = collections.defaultdict(set)
    for x in nodes:
        out[root(x)].add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_are_all_links_however_lists_are_split(spark, bits):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (12, 40, 4)).astype(np.uint64)
    near = np.unique(np.concatenate([(centre[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).reshape(-1), centre, centre[0] ^ np.arange(600, dtype=np.uint64)])).view(np.int64)
    known = near.view(np.uint64)
    pairs = [(int(near[i]), int(near[i + 1 + j])) for i in range(len(known)) for j in np.flatnonzero(np.bitwise_count(known[i + 1 :] ^ known[i]) <= bits).tolist()]
    fps = spark.createDataFrame([(int(x),) for x in near], "fp long")
    want = groups(near.tolist(), pairs)
    for tallied in (3, 64, 1 << 20):
        assert groups(near.tolist(), [(r.a, r.b) for r in simhash.links(fps, bits, tallied).collect()]) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in simhash.components(edges).collect()} == {(i, 10) for i in range(11, 61)} | {(101, 100)}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_classes_of_long_lists(spark, monkeypatch, chunk):
    """150 variants of a text share lists of far over 16 entries, in which most similar ones are neither neighbours nor near the first."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r, texts = np.random.default_rng(0), []
    for f in range(150):
        words = [f"w{i}" for i in range(210)]
        for p in r.choice(210, 3, replace=False):
            words[p] = f"f{f}p{p}"
        texts.append(" ".join(words))
    prints = np.array([simhash.near_prints(t, 5) for t in texts], np.uint64)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(206)} for t in texts]
    least = list(range(150))
    for i in range(150):
        shared = ((prints[i] ^ prints[:i]).view(np.uint8).reshape(-1, 4, 8) == 0).sum(axis=2).max(axis=1, initial=0) >= 6
        for j in np.flatnonzero(shared).tolist():
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.similar_filter(docs).collect()) == sorted(set(least))


@pytest.mark.parametrize("chunk", [256, 16])
def test_meetings_of_a_long_list_give_links_only(spark, monkeypatch, chunk):
    """200 texts of one list at Jaccard 0.67, of which some have a twin at 0.9: links between different classes come out, not the pairs that met."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 80, np.uint64)
    own = r.integers(0, 1 << 63, (200, 20), np.uint64)
    sets = [np.unique(np.concatenate([base, o])) for o in own]
    sets += [np.unique(np.concatenate([sets[i][:-5], r.integers(0, 1 << 63, 5, np.uint64)])) for i in range(0, 200, 20)]
    far = 210  # alike, but its fingerprints share no list
    sets.append(sets[1])
    prints = [(i, 7, 7, 7, 7) for i in range(210)] + [(far, -1, -1, -1, -1)]
    listed = spark.createDataFrame([(0, 7, i) for i in range(210)] + [(1, 9, far), (1, 9, 1)], "k short, key long, node long")
    found = simhash.unmet(
        listed,
        spark.createDataFrame([(200, 0)], "node long, component long"),  # one pair is tied already
        spark.createDataFrame(prints, "node long, f0 long, f1 long, f2 long, f3 long"),
        spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, hashes binary"),
        0.8,
    )
    assert sorted((x.a, x.b) for x in found.collect()) == [(i, 200 + i // 20) for i in range(20, 200, 20)]


@pytest.mark.parametrize("most", [1 << 27, 1 << 10])
def test_row_filter_leaves_out_no_key(spark, monkeypatch, most):
    """Few rows beyond the keys are flagged while the bitmap is large enough, and none of the keys is missed when it is not."""
    monkeypatch.setattr(simhash, "MOST_BITS", most)
    rows = spark.range(-20000, 20000).withColumn("text", F.lit("x"))
    keys = spark.range(-20000, 20000, 7).withColumnRenamed("id", "node")
    got = simhash.flagged(rows, "id", keys)
    assert got.columns == ["id", "text", "maybe"] and got.count() == 40000
    maybe = {x.id for x in got.where("maybe").collect()}
    assert maybe >= set(range(-20000, 20000, 7)) and (most < 1 << 20 or len(maybe) < 9000)
    assert simhash.flagged(rows, "id", keys.where("false")).where("maybe").isEmpty()


def test_near_filter_shuffles_no_text_that_stays(spark):
    """Of 4,000 texts three have copies: what stays is not shuffled with its text, and all columns come out."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 1 << 30, 60)), "en") for i in range(4000)]
    rows += [(5000 + i, rows[i][1].upper(), "de") for i in (3, 70, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = spark.createDataFrame([(d, d - 5000 if d >= 5000 else d, t) for d, t, _ in rows], "doc_id long, component_id long, text string")
    found = found.select("doc_id", simhash.row_key().alias("row_key"), "component_id")
    out = simhash.without_copies(docs, found, "doc_id", "text")
    assert sorted(tuple(x) for x in out.collect()) == rows[:4000] and out.columns == docs.columns
    kept = simhash.flagged(docs.withColumn("key", simhash.row_key()), "key", found.where("doc_id <> component_id").select("row_key"))
    assert kept.where("maybe").count() < 500


def test_op3(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    want = []
    for (i, _), x in zip(ROWS, norm):
        ids = [j for (j, _), y in zip(ROWS, norm) if x == y]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(x.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs)
    assert collect(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.dedup_filter(docs).count() == sum(k for _, _, _, k, _ in want)


def test_heavy_hitters_take_the_broadcast_way(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('t', id) END AS text")
    digests = hot.selectExpr("doc_id", "sha2(text, 256) AS text_sha256")
    assert [(r.keep_id, r.group_size) for r in exact_dedup.frequent_digests(digests, 64, 16).collect()] == [(0, 1000)]
    got = exact_dedup.exact_dedup(hot, counters=64, heavy=16)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000").count() == 1000


def test_op4(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b(t)).hexdigest(), ids))
    got = byte_bpe.encode_documents(docs, path, P.PATTERN)
    assert collect(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(want, key=repr)
    assert byte_bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_bpe_of_random_strings():
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(4)
    parts = ["a", "aa", "b", "é", " ", "  ", "\n", "\t", "'s", "1", "²", "\xa0", "\x1c", "the", "ing", "\r\n", "漢", "!", "__"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000]
    split, (replay, _) = byte_bpe.regex.compile(P.PATTERN), byte_bpe.vocabulary(path)
    pieces = [[x.encode() for c in byte_bpe.chunks(t.encode()) for x in split.findall(c)] for t in texts]
    known = sorted({x for p in pieces for x in p})
    ids = dict(zip(known, replay.encode(known)))
    assert [[i for x in p for i in ids[x]] for p in pieces] == [enc.encode_ordinary(t) for t in texts]


def test_op5(spark, docs, empty):
    def frame(n, bad):
        rng = np.random.default_rng(n)
        out = []
        for i in range(n):
            w = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
            if toxic := i % 2:
                w[3] = w[20] = bad
            out.append((i, " ".join(w), int(toxic)))
        return out

    train = frame(200, "blockhead")
    d, labels = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert [r.held_out for r in sorted(got, key=lambda r: r.doc_id)] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    model = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train])
    assert model.word_scores([b"blockheadz"])[0] > 5 * abs(model.word_scores([b"abcdegfh"])[0])  # an unseen misspelling
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0


def least_sequences(lengths, capacity):
    """No packing has fewer: pieces over half a sequence can't share one, and what fits beside them is limited by their room."""
    most = 0
    for k in range(capacity // 2 + 1):
        alone, large = sum(n > capacity - k for n in lengths), [n for n in lengths if capacity / 2 < n <= capacity - k]
        small = sum(n for n in lengths if k <= n <= capacity / 2)
        most = max(most, alone + len(large) + max(0, -(-(small - sum(capacity - n for n in large)) // capacity)))
    return most


def test_op6(docs, empty):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    rows = packing.best_fit_pack(docs, P.path("word_bpe_49k.json"), capacity=256).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 256
    assert len(held) <= 1.01 * least_sequences([n for *_, n, _ in want], 256) + 1
    assert packing.best_fit_pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_packing_places_every_piece_once():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 513), 80, False), rng.integers(1, 500, 80))}
    found = packing.solve(histogram, 512)
    placed = collections.Counter()
    for config, times in found:
        assert sum(k * n for k, n in config.items()) <= 512
        for k, n in config.items():
            placed[k] += n * times
    assert placed == histogram
    assert sum(t for _, t in found) <= 1.03 * -(-sum(k * n for k, n in histogram.items()) // 512)


def test_the_program_covers_the_demand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    histogram = {r["length"]: r["count"] for r in packing.pieces(docs, P.path("word_bpe_49k.json")).groupBy("length").count().collect()}
    left = {k: n for k, n in histogram.items() if k < 4096}
    classes = packing.Classes.of(left, packing.CLASSES)
    used = packing.fractional(classes, 4096)
    covered = np.zeros(len(classes.size))
    for config, x in used:
        assert sum(int(classes.size[i]) * n for i, n in config.items()) <= 4096
        for i, n in config.items():
            covered[i] += n * x
    share = (np.minimum(covered, classes.demand) * classes.size).sum() / (classes.demand * classes.size).sum()
    tokens = sum(k * n for k, n in histogram.items())
    whole = sum(n for _, n in packing.rounded(used))
    assert share >= 0.98 and abs(whole - sum(x for _, x in used)) <= 0.5
    assert sum(t for _, t in packing.solve(histogram)) <= 1.005 * -(-tokens // 4096) + 1


def test_op8(docs, empty):
    want = []
    for i, t in ROWS:
        t = t or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, hit = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7)), set()
        for p in range(len(w) - 7):
            if seen[tuple(w[p : p + 8])] > 1:
                hit.update(range(p, p + 8))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.quality_verdicts(docs.select("doc_id", "text"))
    assert collect(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not [r for r in got.collect() if r.kept and r.base_failed]
    assert quality.quality_verdicts(empty.select("doc_id", "text")).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns
    clash = docs.withColumns({"n_words": F.lit(-1), "q_words": F.lit(-2), "q_row": F.lit(-3), "kept": F.lit("k")})
    assert collect(quality.quality_verdicts(clash), "doc_id", "n_words", "q_words", "q_row") == sorted([(w[0], w[1], -2, -3) for w in want], key=repr)
    assert collect(quality.quality_filter(clash), "doc_id", "kept", "q_words") == sorted([(r.doc_id, "k", -2) for r in got.collect() if r.kept], key=repr)


def test_cascade_order_changes_no_verdict(docs):
    split = quality._texts(docs, "text", ["doc_id"])
    text, words = F.col("q_text"), F.col("q_words")
    rules = quality.base_rules(text, words) | quality.style_rules(text, words)
    plans = quality.plan_cascade(split, rules)
    assert sorted(n for n, _, _ in plans) == sorted(rules) and [x[2] / max(x[1], 1e-9) for x in plans] == sorted((x[2] / max(x[1], 1e-9) for x in plans), reverse=True)
    verdict = lambda names: collect(split.select("q_row.doc_id", quality.cascade(rules, names).isNull().alias("ok")), "doc_id", "ok")
    assert verdict(list(rules)) == verdict(list(rules)[::-1])


def op9_wanted():
    toks = [[*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), b(t))), None] for _, t in ROWS]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in ROWS]
    c, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for x, out in zip(toks, held):
        if not out:
            c.update(x)
            c["^"] += 1
            two["^", "^"] += 1
            two.update(zip(["^", *x], x))
            three.update(zip(["^", "^", *x], ["^", *x], x))
    n, v, want = sum(c.values()) - c["^"], len(c) - ("^" in c), []
    for (i, _), x, out in zip(ROWS, toks, held):
        p = []
        for u, a, w in zip(["^", "^", *x], ["^", *x], x):
            low = (two[a, w] + 4 * (c[w] + 1) / (n + v + 1)) / (c[a] + 4)
            p.append((three[u, a, w] + 4 * low) / (two[u, a] + 4))
        want.append((i, out, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), sum(map(math.log10, p))))
    return want


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "owner_bytes": 2000}])
def test_op9(docs, empty, sizes):
    got = collect(lm.lm_scores(docs, **sizes), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    line = lambda r: repr(r[:4]) + f"{r[5]:.3f}"
    for a, w in zip(sorted(got, key=line), sorted(op9_wanted(), key=line)):
        assert a[:5] == w[:5] and math.isclose(a[5], w[5], rel_tol=1e-9) and abs(a[6] - w[6]) <= 3e-4 * w[2]
    assert len(got) == len(ROWS) and lm.lm_scores(empty).count() == 0


def test_op9_without_training_rows(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm.lm_scores(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert len(rows) == len(ids) and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 for r in rows)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(6)
    for n, u in ((0, 9), (1, 1), (5, 1 << 40), (3000, 3500), (3000, 1 << 33)):
        x = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        ef = elias_fano.EliasFano(x, u)
        assert (ef[np.arange(n)] == x).all()
        ask = np.concatenate([x, rng.integers(0, u, 500).astype(np.uint64)]) if n else np.zeros(0, np.uint64)
        at = ef.find(ask)
        assert (x[at[at >= 0]] == ask[at >= 0]).all() and (np.isin(ask, x) == (at >= 0)).all()
    triples = np.unique(rng.integers(0, 30, (2000, 3)), axis=0).astype(np.uint64)
    pairs, of = np.unique(triples[:, :2], axis=0, return_inverse=True)
    trie = elias_fano.Trie(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)).astype(np.uint16), of.reshape(-1), triples[:, 2], np.arange(len(triples)).astype(np.uint16))
    known = {tuple(t): i for i, t in enumerate(triples.tolist())}
    ask = rng.integers(0, 34, (3000, 3)).astype(np.uint64)
    found = trie.triples.value(trie.find_triples(trie.find_pairs(ask[:, 0], ask[:, 1]), ask[:, 2]), 65535)
    assert found.tolist() == [known.get(tuple(a), 65535) for a in ask.tolist()]


def test_op10(spark):
    big, same = "<p>" + "x" * 200, "<html>" + "word " * 60
    rows = [(4, "http://a", same), (2, None, same), (9, "http://b\r\nX: y", same), (None, "u", same), (5, "u", big), (6, "u", None), (7, "u", ""), (8, "u", "short"), (1, "u", "short"), (3, "u", "\r\n\r\nWARC/1.1 " + same), (5, "u", big), (11, "u", "ü" * 70000)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, p int").repartition(2)
    manifest, folder = warc.archive_pages(pages)
    want = []
    for i, _, h in rows:
        first = min((j for j, _, g in rows if b(g) == b(h) and j is not None), default=math.inf)
        again = len(b(h)) >= 100 and (math.inf if i is None else i) > first and first < math.inf
        want.append((i, len(b(h)), hashlib.sha256(b(h)).hexdigest(), "revisit" if again else "response", first if again else None))
    assert collect(warc.read(manifest, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    manifest, folder = warc.archive_pages(pages.limit(0))
    assert warc.read(manifest, folder).count() == 0


def test_archive_carries_its_dictionary():
    records = [warc.record(i, "u", (f"<html><body>page {i} " + "common words of every page " * 20).encode(), "d", None, "1970-01-01T00:00:00Z") for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.records_of(data)) == records
    few = warc.archive(records[:2])
    assert few[:4] == data[:4] and list(warc.records_of(few)) == records[:2] and list(warc.records_of(b"")) == []


def cut_repeats(rows, width=50):
    """Texts without the bytes that a 50-byte string of a smaller document covers."""
    least = {}
    for i, t in rows:
        for p in range(len(b(t)) - width + 1):
            k = b(t)[p : p + width]
            least[k] = min(least.get(k, math.inf), i)
    out = []
    for i, t in rows:
        x, gone = b(t), bytearray(len(b(t)))
        for p in range(len(x) - width + 1):
            if least[x[p : p + width]] < i:
                gone[p : p + width] = bytes([1]) * width
        out.append((i, bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs.select("doc_id", "text")).collect()}

    def grams(t):
        w = b(t).lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for name, stage in c.STAGES[:-1]:
        before, docs = docs, c.runtime.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns
        had, has = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in (before, docs))
        if name == "quality_rules":
            assert sorted(has) == sorted((i, t) for i, t in had if verdict[i])
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            assert sorted(has) == sorted((i, t) for i, t in had if i == min(j for j, u in had if norm(u) == norm(t)))
        if name == "simhash_near_dedup":
            sets = [(i, grams(t)) for i, t in had]
            pairs = [(i, j) for x, (i, p) in enumerate(sets) for j, q in sets[:x] if len(p & q) >= 0.8 * len(p | q)]
            assert sorted(i for i, _ in has) == sorted(min(g) for g in groups([i for i, _ in had], pairs))
        if name == "suffix_array_dedup":
            assert sorted(has) == sorted(cut_repeats(had)) and docs.where("n_chars <> length(text)").count() == 0
    pieces = c.STAGES[-1][1](spark, docs, sf_dir).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)


def test_words_encoded_together_are_as_alone():
    words = ["plain", "Don't", "a0b", "0", "<|endoftext|>", "x<|startoftext|>y", "\u0301mark", "e\u0301", "\u00a0", "x\u2003y", "\u0660\uff10", "\u1100\u1161", "ß\u0130ΣΑΣ", "12'll", "…—", "\x1c\x85", "漢字", "\ufffd"]
    words = [f"{w}{i}".replace("0", "1") if i % 3 else w for i in range(40) for w in words]
    tok, calls = Tokenizer.from_file(P.path("word_bpe_49k.json")), []

    class Counted:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return tok.encode_batch_fast(texts, **more)

    sizes, ids = packing.encoded(Counted(), words)
    want = [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert sum(calls) < len(words) / 4


def test_toxicity_rows_are_bounded_and_settled(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (4, None), (5, 7)], "doc_id long, toxic int")
    texts, marks = toxicity.training_rows(docs, labels, per_class=10)
    assert marks.count(0) <= 10 and marks.count(1) <= 10 and len(texts) == len(set(texts)) and "text 3 " * 50 not in texts
    texts, _ = toxicity.training_rows(docs, labels, class_bytes=1000)
    assert sum(map(len, texts)) <= 2000


def test_op5_query_is_the_model_on_each_row(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    for r, d in zip(queries.op5_toxicity(spark, sf_dir).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        w = toxicity.tokens(d.text)
        p = model.probability(sum(model.word_scores([x])[0] for x in w) / len(w) if w else 0.0)
        assert r.doc_id == d.doc_id and math.isclose(r.score, p, abs_tol=1e-9) and r.predicted == int(p >= 0.7) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("name", ["op1_recompression", "op4_byte_bpe", "op7_suffix_dedup", "op9_lm"])
def test_registered_queries_equal_brute_force(spark, sf_dir, monkeypatch, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setitem(globals(), "ROWS", rows)
    got = queries.QUERIES[name](spark, sf_dir)
    if name == "op1_recompression":
        assert collect(got, "doc_id", "n_words", "n_removed", "kept_sha256") == op1_wanted()
    if name == "op7_suffix_dedup":
        want = [(i, len(x), sum(g), sum(y and not z for y, z in zip(g, [False, *g])), hashlib.sha256(bytes(c for c, y in zip(x, g) if not y)).hexdigest()) for i, x, g in removal(b, 50)]
        assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    if name == "op4_byte_bpe":
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
        ids = [(i, enc.encode_ordinary(t or "")) for i, t in rows]
        want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(b(t)).hexdigest()) for (i, x), (_, t) in zip(ids, rows)]
        assert collect(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    if name == "op9_lm":
        for a, w in zip(sorted(map(tuple, got.collect())), sorted(op9_wanted())):
            assert a[:5] == w[:5] and math.isclose(a[5], w[5], rel_tol=1e-9) and abs(a[6] - w[6]) <= 3e-4 * w[2]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
