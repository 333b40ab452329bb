"""An Elias-Fano n-gram trie whose levels are memory-mapped, in numpy."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U64 = np.uint64
#: SELECT[b, k]: place of the k-th one in byte b, by rule.
SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        SELECT[_b, _k] = _i
#: Values unpacked or packed at once.
LOT = 1 << 18


def mapped(a: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped scratch file, which has no name and goes with its last user."""
    a = np.ascontiguousarray(a)
    if not a.nbytes:
        return a
    with tempfile.TemporaryFile() as f:
        f.write(a.data)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), a.nbytes, access=mmap.ACCESS_READ), a.dtype).reshape(a.shape)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with directories of ones and zeros."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(U64)
        self.n = n = len(values)
        self.low_bits = low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        if low:
            lots = []
            for at in range(0, n, LOT):  # LOT values take a whole number of bytes
                lane = values[at : at + LOT, None] >> np.arange(low, dtype=U64) & U64(1)
                lots.append(np.packbits(lane.astype(np.uint8).reshape(-1), bitorder="little"))
            self.low = mapped(np.concatenate([*lots, np.zeros(8, np.uint8)]))
        ones = (values >> U64(low)).astype(np.int64) + np.arange(n)
        self.buckets = (max(1, universe) - 1 >> low) + 1
        raw = np.zeros((n + self.buckets) // 64 * 64 + 64, np.uint8)
        raw[ones] = 1
        packed = np.packbits(raw, bitorder="little")
        self.high = mapped(packed.reshape(-1, 8))
        per = np.bitwise_count(packed.view(U64)).astype(np.int64)
        self.ranks = mapped(np.concatenate([[0], np.cumsum(per)]))
        self.blanks = mapped(np.concatenate([[0], np.cumsum(64 - per)]))

    @staticmethod
    def _select(directory: np.ndarray, octets_of: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (flip: zero) by a directory of 64-bit words."""
        word = np.searchsorted(directory, k, side="right") - 1
        left = k - directory[word]
        octets = octets_of[word] ^ np.uint8(255) if flip else octets_of[word]
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        octet = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left -= np.where(octet > 0, upto[row, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + SELECT[octets[row, octet], left]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        lane = self.low[(at >> 3)[:, None] + np.arange(8)]
        return lane.view(U64).reshape(-1) >> (at & 7).astype(U64) & U64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        return (self._select(self.ranks, self.high, i, False) - i).astype(U64) << U64(self.low_bits) | self.lows(i)

    def until(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have at most these high bits."""
        return self._select(self.blanks, self.high, bucket, True) - bucket

    def find(self, want: np.ndarray) -> np.ndarray:
        """Places of the values, -1 for those not there: the successor of each in its own bucket."""
        out = np.full(len(want), -1)
        for at in range(0, len(want), LOT):
            w = want[at : at + LOT].astype(U64)
            bucket, low = (w >> U64(self.low_bits)).astype(np.int64), w & U64((1 << self.low_bits) - 1)
            hi = self.until(bucket)
            lo = np.where(bucket > 0, self.until(np.maximum(bucket - 1, 0)), 0)
            end = hi.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                less = self.lows(mid) < low[open_]
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            hit = np.flatnonzero(lo < end)
            hit = hit[self.lows(lo[hit]) == low[hit]]
            out[at + hit] = lo[hit]
        return out

    @property
    def nbytes(self) -> int:
        return self.high.nbytes + self.ranks.nbytes + self.blanks.nbytes + (self.low.nbytes if self.low_bits else 0)


class Level:
    """One level of a trie: a node's children are a stretch of the level, kept monotone by adding parent * fan-out to a child's number."""

    def __init__(self, parent: np.ndarray, child: np.ndarray, parents: int, value: np.ndarray):
        """parent must be sorted, and child within a parent; value is the quantised probability of each."""
        self.names = mapped(np.unique(child))
        self.wide = max(1, len(self.names))
        number = np.searchsorted(self.names, child).astype(U64)
        self.nodes = EliasFano(parent.astype(U64) * U64(self.wide) + number, max(1, parents) * self.wide)
        self.pointers = EliasFano(np.searchsorted(parent, np.arange(parents + 1)), len(parent) + 1)
        self.values = mapped(value)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Places of the children of these parents (-1: none), -1 for those not there."""
        out = np.full(len(parent), -1)
        if not len(self.names):
            return out
        number = np.minimum(np.searchsorted(self.names, child), self.wide - 1)
        at = np.flatnonzero((parent >= 0) & (self.names[number] == child))
        out[at] = self.nodes.find(parent[at].astype(U64) * U64(self.wide) + number[at].astype(U64))
        return out

    def children(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each parent's stretch."""
        return self.pointers[parent].astype(np.int64), self.pointers[np.asarray(parent) + 1].astype(np.int64)

    def value(self, place: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(place), missing, self.values.dtype)
        out[place >= 0] = self.values[place[place >= 0]]
        return out


class Trie:
    """Three levels: words v, the words w that follow each, and the words u that stand before each (v, w)."""

    def __init__(self, v: np.ndarray, w: np.ndarray, pair_value: np.ndarray, pair: np.ndarray, u: np.ndarray, value: np.ndarray):
        """Distinct pairs sorted by (v, w); distinct triples sorted by (number of their pair, u)."""
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        self.roots = mapped(v[head])
        self.pairs = Level(np.repeat(np.arange(len(head)), np.diff(np.append(head, len(v)))), w, len(head), pair_value)
        self.triples = Level(pair, u, len(v), value)

    def find_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(v), -1)
        root = np.minimum(np.searchsorted(self.roots, v), len(self.roots) - 1)
        return self.pairs.find(np.where(self.roots[root] == v, root, -1), w)

    def find_triples(self, pair: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self.triples.find(pair, u)
