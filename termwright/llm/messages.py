"""Blocks of documents and owners of keys that write to each other: rows of packed arrays, dealt by Spark.

A block is a few megabytes of text, cut from its input partition without a shuffle and written to the shared
folder before anything depends on it. Blocks ask owners about distinct keys and owners answer by block, in the
order asked. Every row is addressed; a round is one shuffle to the addressees and one pass over their groups,
and what one of them holds is bounded: a block by its size, an owner by there being more owners on larger inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession

from termwright.llm.runtime import partitions, trim

U64 = np.uint64
NO_ID = (1 << 63) - 1
DDL = "dest long, kind int, source long, a long, b long, parts array<binary>"
SCHEMA = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("parts", pa.list_(pa.binary()))])
#: Text of a block, and text for each owner of keys.
BLOCK_BYTES = 8 << 20
OWNER_BYTES = 32 << 20

Parts = list[bytes]
Row = tuple[int, int, int, int, int, Parts]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def pack(a: np.ndarray) -> bytes:
    """An array as Zstandard over its bytes of equal weight."""
    a = np.ascontiguousarray(a)
    return zstd.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted unsigned array by its differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes, kind: type = U64) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def bits(flags: np.ndarray) -> bytes:
    return pack(np.packbits(flags)) if flags.any() else b""


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(raw, np.uint8), count=n).astype(bool) if raw else np.zeros(n, bool)


def table(rows: list[Row]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(SCHEMA), SCHEMA)], schema=SCHEMA)


def owners_for(text_bytes: int, spark: SparkSession, each: int = OWNER_BYTES) -> int:
    return max(partitions(spark), -(-text_bytes // each))


class Mail:
    """What one addressee got: rows by kind, in the order of their senders."""

    def __init__(self, got: pa.Table, dest: int | None = None):
        self.rows: dict[int, list[Row]] = {}
        names = [got.column(f.name).to_pylist() for f in SCHEMA]
        for r in zip(*names):
            if dest is None or r[0] == dest:
                self.rows.setdefault(r[1], []).append(r)
        for rs in self.rows.values():
            rs.sort(key=lambda r: (r[2], r[3], r[4]))

    def __getitem__(self, kind: int) -> list[Row]:
        return self.rows.get(kind, [])

    def one(self, kind: int) -> Parts | None:
        return self.rows[kind][0][5] if kind in self.rows else None


def visit(rows: DataFrame, fn: Callable[[int, Mail], pa.Table], schema: str = DDL) -> DataFrame:
    """Every addressee of the rows looks at its mail."""

    def run(got: pa.Table) -> pa.Table:
        out = fn(got.column("dest")[0].as_py(), Mail(got))
        trim()
        return out

    return rows.repartition(partitions(rows.sparkSession), "dest").groupBy("dest").applyInArrow(run, schema)


def visit_with(base: DataFrame, rows: DataFrame, fn: Callable[[int, Mail], pa.Table], schema: str = DDL) -> DataFrame:
    """As visit, for the addressees of base; several calls in one plan share the shuffle of base."""
    count = partitions(base.sparkSession)
    names = [f.name for f in SCHEMA]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = pa.concat_tables([left.select(names).cast(SCHEMA), right.select(names).cast(SCHEMA)])
        out = fn(got.column("dest")[0].as_py(), Mail(got))
        trim()
        return out

    return base.repartition(count, "dest").groupBy("dest").cogroup(rows.repartition(count, "dest").groupBy("dest")).applyInArrow(run, schema)


def settle(asked: DataFrame, owners: int, kind: int, own: Callable[[int, list[int], list[Parts]], list[tuple[int, int, Parts]]]) -> DataFrame:
    """Owners' answers to the rows asked, addressed to those who asked. own() sees who asked its owner what, in the order of who asked, and answers each with a, b and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple[int, Parts]]] = {}
        for batch in batches:
            for dest, source, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 5))):
                mine.setdefault(dest, []).append((source, parts))
        while mine:
            owner, rows = mine.popitem()
            rows.sort(key=lambda r: r[0])
            sources = [s for s, _ in rows]
            for source, (a, b, parts) in zip(sources, own(owner, sources, [p for _, p in rows])):
                yield from table([(source, kind, owner, a, b, parts)]).to_batches()
        trim()

    return asked.repartitionById(owners, asked["dest"].cast("int")).mapInArrow(run, DDL)


def by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner that has any of the keys, and the places of its keys in order."""
    order = np.argsort(owner, kind="stable")
    heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for x in np.split(order, heads[1:]) if len(order) else []:
        yield int(owner[x[0]]), x


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all the ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(heads - starts, sizes)


def cover(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places the ranges cover."""
    starts = np.asarray(starts, np.int64)
    ends = starts + sizes
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
