"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at most two bits apart differ in at most two
bytes, so they share at least six of the eight (position, byte) tokens: that is the guaranteed minimum. Each distinct
fingerprint is posted under five triples of positional bytes, chosen so that any six positions hold one of them.
In a list, the shared positional bytes of every pair are tallied, pairs that reach six are verified by their
differing bits, and a spanning forest of the verified pairs goes on. A list too long for that is split by the
tokens at three further positions, of which a pair that reaches six shares at least one, and so on until six
positions are shared, where two free bytes bound a list by 65,536 entries whatever the corpus.
Classes are the connected components, found by alternating large-star and small-star joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from termwright.llm.runtime import id_text, materialize, partitions

SEED = 42
#: Shingles whose bits are counted at once, which bounds memory on very long texts.
BLOCK = 1 << 15
FREE = list(combinations(range(8), 2))
#: Triples of positions: whichever two positions differ, one of the triples has neither.
TRIPLES = ((0, 1, 2), (3, 4, 5), (6, 7, 0), (6, 7, 3), (6, 7, 1))
#: Entries of a posting list that are tallied pair by pair; longer lists are split.
LIST = 64
#: Exclusive-or masks and odd factors of 24 min-wise samples.
MINWISE = np.random.default_rng(SEED).integers(0, 1 << 64, (24, 2), np.uint64) | np.array([0, 1], np.uint64)
#: The bytes of a fingerprint that the pair of free positions leaves.
KEEP = np.array([~((0xFF << 8 * i) | (0xFF << 8 * j)) & (1 << 64) - 1 for i, j in FREE], np.uint64)
#: Posting lists of near_prints up to this length are compared pair by pair; of longer ones only pairs that other pairs have not tied.
ALL_PAIRS = 16
#: Shingle sets of a group of long lists, and bytes of them, that meet as many others in one task; distinct hashes counted at once there.
CHUNK, CHUNK_BYTES, COLUMNS = 256, 1 << 20, 4096
#: Bits for each key of a row filter, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 27


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, a block at a time; nothing without words; of the whole sequence if it is shorter."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return
    joined = b" ".join(toks)
    k = min(words, len(toks))
    ends = [e + i for i, e in enumerate(accumulate(map(len, toks)))]
    starts = [0, *(e + 1 for e in ends)]
    n = len(toks) - k + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1])), np.uint64, to - at)


def majority(blocks: Iterator[np.ndarray]) -> int:
    """64 majority bits of hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 majority bits of the XXH64 of all word shingles; 0 without words; the whole sequence if it is shorter."""
    return majority(shingle_hashes(text, words))


def row_key(text_col: str = "text") -> Column:
    """With the doc_id, what tells rows apart; rows that agree in both are the same document."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, its fingerprint as a signed long, and the row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], names=["doc_id", "fp", "row_key"])

    return id_text(docs, id_col, text_col).withColumn("row_key", row_key()).mapInArrow(run, "doc_id long, fp long, row_key long")


def list_links(fps: np.ndarray, max_bits: int, tallied: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the pairs at most max_bits apart in one posting list, which is sorted."""
    m, links = len(fps), []
    boss = list(range(m))

    def root(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    def tie(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            boss[a] = b
            links.append((i, j))

    if m <= tallied:
        for i in range(m - 1):
            diff = fps[i + 1 :] ^ fps[i]
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            for j in np.flatnonzero((shared >= 6) & (np.bitwise_count(diff) <= max_bits)).tolist():
                tie(i, i + 1 + j)
        return links
    # six positions are shared here: each entry's neighbours differ in bits of the other two
    spread = np.bitwise_or.reduce(fps[0] ^ fps)
    free = [np.uint64(1) << np.uint64(b) for b in range(64) if (spread >> np.uint64(b)) & np.uint64(1)]
    for flip in [np.bitwise_or.reduce(np.array(x)) for k in range(1, max_bits + 1) for x in combinations(free, k)]:  # at most 16 + 120
        at = np.searchsorted(fps, want := fps ^ flip)
        hit = np.flatnonzero((at < m) & (fps[np.minimum(at, m - 1)] == want))
        for i, j in zip(hit.tolist(), at[hit].tolist()):
            tie(i, j)
    return links


def byte_mask(positions: int) -> int:
    """The bytes at the positions whose bits are set, as a signed long."""
    mask = sum(0xFF << 8 * i for i in range(8) if positions >> i & 1)
    return mask - (1 << 64) if mask >> 63 else mask


def posting(positions: int) -> Column:
    return F.struct(F.lit(positions).alias("positions"), F.col("fp").bitwiseAND(F.lit(byte_mask(positions))).alias("key"))


def narrower(positions: int) -> list[int]:
    """With one further shared position, of three: a pair that misses at most two shares one of them."""
    return [positions | 1 << i for i in [i for i in range(8) if not positions >> i & 1][:3]]


def links(fps: DataFrame, max_bits: int = 2, tallied: int = LIST) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints; fps has fp. `tallied` changes the way, not the result."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the count filter guarantees links of at most two bits")
    masks = [sum(1 << i for i in t) for t in TRIPLES]
    posted = fps.select(F.explode(F.array(*map(posting, masks))).alias("x"), "fp").select("x.*", "fp")
    lists = None
    for shared in range(3, 7):
        sized = posted.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("positions", "key")))
        if shared < 6:
            sized = materialize(sized.where("size > 1"), "postings")
        short = sized.where(F.col("size").between(2, tallied) if shared < 6 else F.col("size") > 1).select("positions", "key", "fp")
        lists = short if lists is None else lists.unionByName(short)
        if shared == 6 or (long := sized.where(F.col("size") > tallied)).isEmpty():
            break
        children = F.lit(None)
        for m in masks:
            children = F.when(F.col("positions") == m, F.array(*map(posting, narrower(m)))).otherwise(children)
        posted = long.select(F.explode(children).alias("x"), "fp").select("x.*", "fp").distinct()
        masks = sorted({n for m in masks for n in narrower(m)})
    dealt = lists.repartition(partitions(fps.sparkSession), "positions", "key").sortWithinPartitions("positions", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            k, key, fp = cols
            edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1, [len(k)]])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, n in zip(edge[:-1].tolist(), np.diff(edge).tolist()):
                one = np.sort(fp[s : s + n].view(np.uint64))
                if pairs := list_links(one, max_bits, tallied):
                    i, j = np.array(pairs).T
                    a.append(one[i].view(np.int64)), b.append(one[j].view(np.int64))
            x, y = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held and len(held[0]):
            yield found(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest reachable node) of every node in edges (a, b): alternating large and small stars.

    Every round's edges are written to the shared folder, so a round never recomputes the one before it.
    """
    pairs = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("m", F.col("v").alias("w")), F.struct("m", F.col("u").alias("w")))).alias("x"))
        pairs = materialize(small.select(F.col("x.m").alias("v"), F.col("x.w").alias("u")).where("u <> v").distinct(), "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its class).

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    count as one document. A null doc_id ranks after every id; a class of null ids only has a null component.
    An empty table gives an empty result. Other columns are ignored.
    """
    return found_classes(docs, id_col, text_col, words, max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def found_classes(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> DataFrame:
    """doc_id, row_key, fp and component_id of every row."""
    docs_fp = materialize(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = docs_fp.select("fp").distinct()
    return with_components(docs_fp, links(fps, max_bits), "fp")


def with_components(rows: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Adds component_id, the smallest doc_id of each row's class: nodes are tied by edges (a, b) and by doc_ids they share."""
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("doc_id").agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a <> z").select("doc_id", "a")
    ties = known.join(first, "doc_id").select("a", F.col(node).alias("b")).where("a <> b").distinct()
    stars = components(edges.select("a", "b").unionByName(ties))
    ids = rows.groupBy(F.col(node).alias("node")).agg(F.min("doc_id").alias("least"))
    classes = ids.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "least")
    classes = materialize(classes, "classes")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    of = materialize(classes.join(least, "class").select(F.col("node").alias(node), "component_id"), "class-ids")
    return rows.join(of, node)


def near_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """Rows of the smallest doc_id of every class, all their columns unchanged, whatever those are called; all rows of a class without ids."""
    return without_copies(docs, found_classes(docs, id_col, text_col, words, max_bits), id_col, text_col)


def flagged(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with `maybe`: true wherever keys, a table of one column of longs, has the row's key, and for a few others.

    A bitmap of hashed keys, bounded by MOST_BITS and broadcast: wide rows that no key calls for need no shuffle. With more
    keys it tells less, but never leaves out one.
    """
    n = keys.count()
    bits = -(-min(MOST_BITS, max(1, n) * KEY_BITS) // 32768) * 32768
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    mine = spot(F.col(keys.columns[0]))
    maps = keys.groupBy(F.bitmap_bucket_number(mine).alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mine)).alias("bitmap_"))
    at = F.bitmap_bit_position(F.col("spot_"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap_"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    spots = rows.withColumn("spot_", spot(F.col(key))).withColumn("bucket_", F.bitmap_bucket_number(F.col("spot_")))
    return spots.join(F.broadcast(maps), "bucket_", "left").withColumn("maybe", maybe).drop("spot_", "bucket_", "bitmap_")


def without_copies(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs but those that found, which has their doc_id and row_key, puts in the class of another doc_id."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("row_id"), row_key(text_col).alias("key"))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("d"), "row_key").distinct()
    gone = materialize(gone, "gone")
    split = flagged(whole, "key", gone.select("row_key"))
    looked = split.where("maybe").join(gone, (F.col("key") == F.col("row_key")) & F.col("row_id").eqNullSafe(F.col("d")), "left_anti")
    return split.where("not maybe").select("row.*").unionByName(looked.select("row.*"))


def near_prints(text: str | None, words: int) -> list[int]:
    """Four fingerprints of eight positional bytes: the SimHash, and three whose bytes are min-wise samples of the shingles.

    Two texts agree in a min-wise byte with the chance of their Jaccard similarity, 0.8 at 0.8, where a
    SimHash byte agrees with 0.27: three times six of eight find 99 % of such pairs, SimHash next to none.
    """
    blocks = list(shingle_hashes(text, words))
    low = np.full(len(MINWISE), (1 << 64) - 1, np.uint64)
    for h in blocks:
        for at in range(0, len(h), 2048):
            np.minimum(low, ((h[at : at + 2048, None] ^ MINWISE[:, 0]) * MINWISE[:, 1]).min(axis=0), out=low)
    byte = (((low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    return [majority(iter(blocks)), *byte.view(np.uint64).tolist()]


def list_pairs(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one posting list: all of a short one; in a long one each entry with the next, the first, and the first of the commonest fingerprint, which leaves few classes for unmet().

    The list is in the order of node, so that lists with the same entries give the same pairs.
    """
    if len(node) <= ALL_PAIRS:
        i, j = np.triu_indices(len(node), 1)
        return node[i], node[j]
    values, first, often = np.unique(fp, return_index=True, return_counts=True)
    hub = node[first[often.argmax()]]
    rest = node[1:]
    return np.concatenate([node[:-1], np.full(len(rest), node[0]), np.full(len(node), hub)]), np.concatenate([rest, rest, node])


def candidates(prints: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share six of eight bytes of a fingerprint (k and key null), and the entries a of the lists k, key that are too long for all their pairs (b null); prints has node and f0 to f3."""
    posts = [F.struct(F.lit(f * len(FREE) + k).cast("short").alias("k"), F.col(f"f{f}").alias("fp")) for f in range(4) for k in range(len(FREE))]
    posted = prints.select(F.explode(F.array(*posts)).alias("x"), "node").select("x.k", "x.fp", "node")
    key = F.col("fp").bitwiseAND(F.element_at(F.lit(KEEP.view(np.int64).tolist()), F.col("k") % len(FREE) + 1))
    dealt = posted.repartition(partitions(prints.sparkSession), "k", key).select("k", key.alias("key"), "fp", "node").sortWithinPartitions("k", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            k, key, fp, node = cols
            edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1, [len(k)]])
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            a, b = [node[two]], [node[two + 1]]
            for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                x, y = list_pairs(fp[s : s + n], node[s : s + n])
                a.append(x), b.append(y)
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
            long = np.repeat(size > ALL_PAIRS, size)
            none, n = np.zeros(len(pairs), bool), int(long.sum())
            listed = np.concatenate([none, np.ones(n, bool)])
            whole = lambda pair, entry, kind: pa.array(np.concatenate([pair, entry]).astype(kind))
            b_, k_, key_ = whole(pairs[:, 1], np.zeros(n, np.int64), np.int64), whole(none, k[long], np.int16), whole(none, key[long], np.int64)
            return pa.RecordBatch.from_arrays([whole(pairs[:, 0], node[long], np.int64), pc.if_else(pa.array(listed), None, b_), pc.if_else(pa.array(listed), k_, None), pc.if_else(pa.array(listed), key_, None)], names=["a", "b", "k", "key"])

        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held and len(held[0]):
            yield found(held)

    return dealt.mapInArrow(run, "a long, b long, k short, key long").distinct()


def met(got: pa.Table, least: float) -> pa.Table:
    """Links between the classes of two chunks of a group that meet: a spanning forest of the pairs that share six of eight bytes of a fingerprint and whose sets have that Jaccard similarity.

    Shared hashes of all pairs are counted at once, as products of incidence matrices of COLUMNS hashes each.
    """
    chunk, kind, node = (got.column(c).to_numpy() for c in ("chunk", "class", "node"))
    left = np.flatnonzero(chunk == got.column("i")[0].as_py())
    right = np.flatnonzero(chunk == got.column("j")[0].as_py())
    prints = np.stack([got.column(f"f{f}").to_numpy() for f in range(4)], 1)
    sets = [np.frombuffer(h.as_py(), np.uint64) for h in got.column("hashes")]
    size = np.array(list(map(len, sets)))
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, again = np.repeat(np.arange(len(sets)), size), often > 1
    keep = again[column]
    row, column = row[keep], (np.cumsum(again) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(again.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    p, q = size[left][:, None], size[right][None, :]
    x, y = np.nonzero((np.minimum(p, q) >= least * np.maximum(p, q)) & (both >= least * (p + q - both)) & (kind[left][:, None] != kind[right][None, :]))
    x, y = left[x], right[y]
    near = [(prints[x[at : at + BLOCK]] ^ prints[y[at : at + BLOCK]]).view(np.uint8).reshape(-1, 4, 8) for at in range(0, len(x), BLOCK)]
    found = np.flatnonzero(np.concatenate([np.zeros(0, bool), *(((d == 0).sum(axis=2) >= 6).any(axis=1) for d in near)]))
    boss = dict.fromkeys(kind.tolist())

    def root(c: int) -> int:
        while boss[c] is not None:
            c = boss[c]
        return c

    links = []
    for i, j in zip(x[found].tolist(), y[found].tolist()):
        if (u := root(int(kind[i]))) != (v := root(int(kind[j]))):
            boss[u] = v
            links.append((min(node[i], node[j]), max(node[i], node[j])))
    return pa.Table.from_arrays([pa.array([z[c] for z in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


def unmet(listed: DataFrame, stars: DataFrame, prints: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different classes of stars (node, component) that long lists hold: with the pairs of candidates(), none that could tie two classes is left out.

    listed has k, key and node. Lists that share entries make a group, dealt to chunks that meet two by two, a task
    each: a set goes once to a chunk of its group, whatever the number of its lists, and only links come out.
    """
    rows = listed.join(stars, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    lists = rows.groupBy("k", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("node").alias("first")).where("low <> high")
    open_ = materialize(rows.join(lists.select("k", "key", "first"), ["k", "key"]).select("node", "class", "first").distinct(), "open-lists")
    groups = components(open_.select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b"))
    ends = open_.select("node", "class").distinct().join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    ends = materialize(ends.join(sets.select("node", F.octet_length("hashes").alias("size")), "node"), "group-entries")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES), F.lit(1)).alias("chunks")
    dealt = ends.join(ends.groupBy("group").agg(chunks), "group").join(prints, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    needed = flagged(sets, "node", ends.select("node")).where("maybe").drop("maybe")
    dealt = dealt.join(needed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("node", "class", "f0", "f1", "f2", "f3", "hashes", "group", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return dealt.groupBy("group", "i", "j").applyInArrow(lambda got: met(got, least), "a long, b long")


def alike(x: bytes, y: bytes, least: float) -> bool:
    """Whether two sets of hashes have at least that Jaccard similarity."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
    return both >= least * (len(p) + len(q) - both)


def shingle_sets(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node and hashes, the sorted distinct shingle hashes, of every node of the pairs; texts has node and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), words)])).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    some = flagged(texts, "node", nodes).where("maybe").drop("maybe")
    return materialize(some.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, hashes binary"), "shingle-sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least `least`."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(p.as_py(), q.as_py(), least) for p, q in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(verified, "a long, b long")


def similar_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of the smallest doc_id of every class of texts that verified pairs of at least that Jaccard similarity tie; columns and null ids as in near_filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([near_prints(t.as_py(), words) for t in b.column(1)], np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(prints[:, i].copy()) for i in range(4))], names=["doc_id", "row_key", "f0", "f1", "f2", "f3"])

    keyed = id_text(docs, id_col, text_col).withColumn("row_key", row_key())
    rows = materialize(keyed.mapInArrow(run, "doc_id long, row_key long, f0 long, f1 long, f2 long, f3 long"), "near-prints")
    prints = rows.select(F.col("row_key").alias("node"), "f0", "f1", "f2", "f3").distinct()
    found = materialize(candidates(prints), "candidates")
    pairs, listed = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select("k", "key", F.col("a").alias("node"))
    sets = shingle_sets(pairs, keyed.select(F.col("row_key").alias("node"), "text"), words)
    edges = similar(pairs, sets, least)
    if not listed.isEmpty():
        stars = materialize(components(edges), "stars")
        late = materialize(unmet(listed, stars, prints, sets, least), "unmet")
        edges = stars.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(late)
    return without_copies(docs, with_components(rows.select("doc_id", "row_key"), edges, "row_key"), id_col, text_col)
