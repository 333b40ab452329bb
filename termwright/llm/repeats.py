"""A conversation of blocks of documents with the owners of keys, for repeated byte strings.

Documents are dealt to blocks. A block cuts its texts into keyed items, in an order that the texts alone
decide, and asks the owner of every distinct key about it. Owners answer by block, in the order asked, so
an answer is a bit for a key and no document or position travels with it. A block that is computed again
asks the same questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from termwright.llm.runtime import partitions, trim

NO_ID = (1 << 63) - 1
#: Text of a block.
BLOCK_BYTES = 4 << 20
U64 = np.uint64
#: A key is hot if so many blocks have it, and together more items with it, of about 16 windows each, than an owner sorts at once: its windows then have owners of their own.
HOT_BLOCKS, HOT_ITEMS = 64, 1 << 14
#: Owners know a key by its top 40 bits; two keys that agree in them only cost a needless question later.
SHORT = U64(24)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed: prefix hashes of any buffer."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            fill = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)]))
            self.up, self.down = fill(self.base), fill(self.inverse)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """Prefix sums of byte times power; a substring's hash is a difference, shifted back by `at`."""
        self.need(len(buf) + 1)
        out = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * self.up[: len(buf)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (prefix[start + size] - prefix[start]) * self.down[start]


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id (null ranks last, as the largest id), h (hash of the text), text, and a struct of the columns to carry."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col(id_col).cast("long").isNull().alias("no_id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []),
    )


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, as Zstandard; nothing for nothing."""
    a = np.ascontiguousarray(a)
    return zstd.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def steps(names: np.ndarray) -> bytes:
    """Sorted names by their differences, whose high bytes are mostly zero."""
    return planes(np.diff(names, prepend=U64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, U64), dtype=U64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() if flags.any() else b""


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if raw else np.zeros(n, bool)


def dealt(docs: DataFrame) -> DataFrame:
    """Documents as made by keyed(), dealt to blocks of about BLOCK_BYTES of text; rows alike in id and text share a block."""
    count = partitions(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(count, -(-size // BLOCK_BYTES)))).cast("int")
    return docs.withColumn("block", block).repartition(count, "block")


class Block:
    """A block's documents, in an order that does not depend on how rows arrived."""

    def __init__(self, table: pa.Table):
        ids, hs = (table.column(c).to_numpy() for c in ("doc_id", "h"))
        order = np.lexsort((hs, ids))
        self.number, self.ids, self.hs = table.column("block")[0].as_py(), ids[order], hs[order]
        self.null = table.column("no_id").to_numpy(zero_copy_only=False)[order].astype(bool)
        texts = table.column("text").to_pylist()
        self.texts: list[bytes] = [texts[i] for i in order.tolist()]
        self.rest = table.take(pa.array(order)).drop_columns(["block", "doc_id", "no_id", "h", "text"])


Parts = list[bytes]
Told = dict[tuple[int, int], Parts]
ASKED = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("parts", pa.list_(pa.binary()))])
TOLD = pa.schema([("block", pa.int32()), ("owner", pa.int32()), ("kind", pa.int32()), ("parts", pa.list_(pa.binary()))])


def replies(table: pa.Table | None) -> Told:
    """Answers by kind of question and owner."""
    return {(r["kind"], r["owner"]): r["parts"] for r in table.to_pylist()} if table is not None else {}


def converse(docs: DataFrame, told: DataFrame | None, ask: Callable[[Block, Told], Iterator[tuple[int, Parts]]], own: Callable[[list[int], list[Parts]], list[tuple[int, int, Parts]]]) -> DataFrame:
    """One question of every block of dealt() to each owner, and the answers, again by block. own() sees all the questions to one owner, with the blocks that ask, and gives answers: block, kind, parts."""
    count = partitions(docs.sparkSession)

    def put(left: pa.Table, right: pa.Table | None) -> pa.Table:
        if not left.num_rows:
            return ASKED.empty_table()
        block = Block(left)
        rows = [(owner, block.number, parts) for owner, parts in ask(block, replies(right))]
        trim()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, ASKED)], schema=ASKED)

    def first(left: pa.Table) -> pa.Table:
        return put(left, None)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows.setdefault(r["owner"], []).append(r)
        while rows:
            owner, mine = rows.popitem()
            mine.sort(key=lambda r: r["block"])
            for block, kind, parts in own([r["block"] for r in mine], [r["parts"] for r in mine]):
                yield pa.RecordBatch.from_pydict({"block": [block], "owner": [owner], "kind": [kind], "parts": [parts]}, schema=TOLD)
        trim()

    ddl = "owner int, block int, parts array<binary>"
    by = docs.groupBy("block")
    asked = by.applyInArrow(first, ddl) if told is None else by.cogroup(told.groupBy("block")).applyInArrow(put, ddl)
    # owners are numbered as partitions are: one owner for each task
    answers = asked.repartitionById(count, F.col("owner")).mapInArrow(settle, "block int, owner int, kind int, parts array<binary>")
    return answers.repartition(count, "block")


def finish(docs: DataFrame, told: DataFrame, close: Callable[[Block, Told], pa.Table], schema: str | object) -> DataFrame:
    """What every block makes of its documents and all its answers."""

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        # a block without questions has no answers; answers always have their block
        out = close(Block(left), replies(right))
        trim()
        return out

    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(end, schema)


def by_owner(key: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner that has any of the keys, and the places of its keys in order. An owner has a range of the keys, so that its keys lie close together however many owners there are."""
    owner = ((key >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for x in np.split(order, heads[1:]) if len(order) else []:
        yield int(owner[x[0]]), x


class Keys:
    """The distinct keys of a block's items: which item has which, and which keys two documents of the block have."""

    def __init__(self, key: np.ndarray, doc_id: np.ndarray):
        order = np.argsort(key)
        k, d = key[order], doc_id[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.of = k[head], np.empty(len(k), np.int64)
        self.of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(k))))
        self.items = np.diff(np.append(head, len(k)))
        self.shared = np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head) if len(k) else np.zeros(0, bool)
        self.hot = np.zeros(len(head), bool)

    def ask(self, count: int) -> Iterator[tuple[int, Parts]]:
        for owner, x in by_owner(self.keys, count):
            yield owner, [steps(self.keys[x] >> SHORT), planes(np.minimum(self.items[x], 0xFFFF).astype(np.uint16))]

    def hear(self, told: Told, count: int, kind: int = 0) -> Keys:
        for owner, x in by_owner(self.keys, count):
            shared, hot = told[kind, owner]
            self.shared[x] |= unbits(shared, len(x))
            self.hot[x] = unbits(hot, len(x))
        return self


def own_keys(blocks: list[int], asked: list[Parts], kind: int, hot_blocks: int, hot_items: int) -> list[tuple[int, int, Parts]]:
    """Which keys another block has too, and which are hot."""
    names = [unsteps(parts[0]) for parts in asked]
    _, at, size = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    at = at.reshape(-1)
    items = np.bincount(at, np.concatenate([unplanes(parts[1], np.uint16) for parts in asked]))
    hot = ((size >= hot_blocks) & (items > hot_items))[at]
    size, ends = size[at], np.cumsum([len(n) for n in names])[:-1]
    return [(b, kind, [bits(s > 1), bits(w)]) for b, s, w in zip(blocks, np.split(size, ends), np.split(hot, ends))]


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all the ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(heads - starts, sizes)


def union(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the ranges cover."""
    starts = np.asarray(starts, np.int64)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
