"""Blocks of tokenised documents, and their words as questions to owners.

A block's row holds its documents' ids, marks and words as numbers local to the block; its distinct words
travel as bytes to their owners, so what owners say about a word holds for that very word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from termwright.llm import messages as M
from termwright.llm.messages import NO_ID
from termwright.llm.runtime import trim

BASE, WORDS = 0, 1


class Numbered(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Block:
    """A block's documents by id: numbers of their words, and which documents are without id or marked."""

    def __init__(self, parts: list[bytes]):
        self.ids, self.sizes = M.unpack(parts[0], np.int64), M.unpack(parts[3], np.uint32).astype(np.int64)
        self.null, self.mark = M.unbits(parts[1], len(self.ids)), M.unbits(parts[2], len(self.ids))
        self.tokens = M.unpack(parts[4], np.uint32)

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    @property
    def distinct(self) -> int:
        return int(self.tokens.max()) + 1 if len(self.tokens) else 0

    @property
    def doc(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)

    def check(self) -> int:
        """What tells this block from others under its number."""
        return zlib.crc32(self.tokens.tobytes(), zlib.crc32(self.ids.tobytes()))

    def parts(self) -> list[bytes]:
        return [M.pack(self.ids), M.bits(self.null), M.bits(self.mark), M.pack(self.sizes.astype(np.uint32)), M.pack(self.tokens)]


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def write_words(words: list[bytes]) -> M.Parts:
    return [M.zstd.compress(b"".join(words), 1), M.pack(np.fromiter(map(len, words), np.uint32, len(words)))]


def read_words(parts: M.Parts) -> list[bytes]:
    """The words of a WORDS row."""
    raw, ends = M.zstd.decompress(parts[2]), np.cumsum(M.unpack(parts[3], np.uint32), dtype=np.int64).tolist()
    return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends)]


def tokenised(docs: list[tuple[int | None, bytes, bool]], split: Callable[[bytes], list]) -> tuple[Block, list[bytes]]:
    """A block, and its distinct words by number, the most frequent first."""
    docs = sorted(docs, key=lambda d: (NO_ID if d[0] is None else d[0], d[0] is None))
    index, flat, sizes = Numbered(), [], []
    for _, text, _ in docs:
        before = len(flat)
        flat.extend(map(index.__getitem__, split(text)))
        sizes.append(len(flat) - before)
    tokens = np.array(flat, np.uint32)
    del flat
    order = np.argsort(-np.bincount(tokens, minlength=len(index)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else w for w in index]
    block = Block.__new__(Block)
    block.ids = np.array([NO_ID if d is None else d for d, _, _ in docs], np.int64)
    block.null = np.array([d is None for d, _, _ in docs], bool)
    block.mark = np.array([bool(m) for _, _, m in docs], bool)
    block.sizes, block.tokens = np.array(sizes, np.int64), rank[tokens]
    return block, [words[i] for i in order.tolist()]


def cut(docs: DataFrame, owners: int, tell: Callable[[Block, int], np.ndarray], id_col: str, text_col: str, mark: Column | None = None, split: Callable[[bytes], list] = bytes.split, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """BASE rows to blocks and WORDS rows to owners: the distinct words that split() makes of texts, their numbers, and what tell() says of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 24, [], 0

        def block(number: int) -> Iterator[pa.RecordBatch]:
            b, words = tokenised(held, split)
            held.clear()
            said = tell(b, len(words))
            owner = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(owners)
            rows, check = [(number, BASE, number, 0, 0, b.parts())], b.check().to_bytes(4, "little")
            for o, x in M.by_owner(owner.astype(np.int64)):
                x = np.sort(x)
                rows.append((o, WORDS, number, 0, 0, [M.pack_sorted(x.astype(np.uint32)), M.pack(said[x]), *write_words([words[i] for i in x.tolist()]), check]))
            for r in rows:
                yield from M.table([r]).to_batches()
            trim()

        for batch in batches:
            for d, t, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((d, t, m))
                size += len(t) + 1
                if size >= block_bytes:
                    yield from block(first)
                    first, size = first + 1, 0
        if held:
            yield from block(first)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), (F.lit(False) if mark is None else mark).alias("mark"))
    return rows.mapInArrow(run, M.DDL)


def spell(rows: list[M.Row], n: int) -> list[bytes]:
    """A block's words by number, from the WORDS rows it sent."""
    out: list[bytes] = [b""] * n
    for r in rows:
        for i, w in zip(M.unpack_sorted(r[5][0], np.uint32).tolist(), read_words(r[5])):
            out[i] = w
    return out


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1), F.lit(0))).first()[0]
