"""Exact removal of repeated word windows by recompression.

Words are symbols, named by owners that compare their bytes. In a round, a block finds maximal runs of one
symbol and splits runs into left and right ones by their name; owners name every distinct adjacent left-right
pair, and every lone run, that two documents have. Names are numbers that owners give out for what they have
compared, so names are equal exactly where the words below are. Every symbol carries the words that decided
it: where a window holds them all, equal windows have the same symbol, so a symbol that only one document has
rules out every window around it. Rounds go on until no symbol fits a window.

Windows that no symbol rules out ask who has them first, by a hash of their words' names, and every stretch
of windows that is said to repeat is verified: its names against those of the place it is said to repeat.
Should two different windows ever share a hash, all that meet are settled by their names themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from termwright.llm import messages as M, tokens as T
from termwright.llm.messages import NO_ID, U64, mix
from termwright.llm.runtime import materialize

NAMES, KEY_NAMES, STATE, KEYS, COVERED, ASK, FIRST, GONE, CLAIM, ODD, BAD = range(2, 13)
#: Bits of a window's hash; tests make it small.
HASH_BITS = 64
#: Words looked at, and symbols combined, at once; these to the end of a stretch without gaps.
COMBINED = 1 << 16


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def gaps_between(gap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether there is a gap before each of the places, if only they are left."""
    gaps = running(gap)[1:]
    before = np.concatenate([[-1], at[:-1]]) if len(at) else at
    return (at - before > 1) | (gaps[at] > gaps[np.maximum(before, 0)]) | (before < 0)


class Symbols:
    """A block's symbols of one level: name, first deciding word and end of the deciding words, and whether the symbol before is out."""

    def __init__(self, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: np.ndarray):
        self.name, self.lo, self.hi, self.gap = name, lo, hi, gap

    def pick(self, keep: np.ndarray) -> Symbols:
        """Those to keep; what stood beside one that goes has a gap there."""
        at = np.flatnonzero(keep)
        return Symbols(self.name[at], self.lo[at], self.hi[at], gaps_between(self.gap, at))

    def parts(self) -> M.Parts:
        return [M.pack(self.name), M.pack_sorted(self.lo.astype(np.uint32)), M.pack((self.hi - self.lo).astype(np.uint32)), M.bits(self.gap)]

    @classmethod
    def of(cls, parts: M.Parts) -> Symbols:
        name, lo = M.unpack(parts[0], U64), M.unpack_sorted(parts[1], np.uint32).astype(np.int64)
        return cls(name, lo, lo + M.unpack(parts[2], np.uint32), M.unbits(parts[3], len(lo)))


class Alive:
    """Which windows, by their first word, may still repeat."""

    def __init__(self, flags: np.ndarray, window: int):
        self.flags, self.window = flags, window
        self.sums = running(flags)

    def around(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a window that may repeat holds each range."""
        a = np.maximum(hi - self.window, 0)
        return (a <= lo) & (self.sums[np.maximum(lo + 1, a)] > self.sums[a])

    def words(self) -> np.ndarray:
        """Which words a window that may repeat holds, some at a time."""
        n = len(self.flags)
        some = [np.arange(i, min(n, i + COMBINED)) for i in range(0, n, COMBINED)]
        return np.concatenate([np.zeros(0, bool), *(self.around(x, x + 1) for x in some)])

    def without(self, lo: np.ndarray, hi: np.ndarray) -> Alive:
        """Minus all windows around these ranges."""
        a = np.maximum(hi - self.window, 0)
        fits = a <= lo
        return Alive(self.flags & ~M.cover(a[fits], (lo - a + 1)[fits], len(self.flags)), self.window)


def windows_of(private: np.ndarray, ends: np.ndarray, window: int) -> Alive:
    """Windows inside one document without a private word."""
    n = len(private)
    flags = np.zeros(n, bool)
    if n >= window:
        bad = running(private)
        flags[: n - window + 1] = bad[window:] == bad[:-window]
        # the last window - 1 words of a document begin none
        ends = ends[np.diff(ends, prepend=0) > 0]
        sizes = np.diff(ends, prepend=0)
        tail = np.minimum(sizes, window - 1)
        flags[M.flat(ends - tail, tail)] = False
    return Alive(flags, window)


def combine(s: Symbols, level: int, window: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """The next level's symbols, unnamed: their deciding words and the runs (A, B) they are made of, B zero for a lone run; zero, zero keeps the name."""
    n = len(s.name)
    if not n:
        return s, np.zeros(0, U64), np.zeros(0, U64)
    head = np.flatnonzero(s.gap | np.concatenate([[True], s.name[1:] != s.name[:-1]]))
    size = np.diff(np.append(head, n))
    tail = head + size - 1
    gap = s.gap[head]
    shut = np.append(s.gap[1:], True)[tail] | gap  # nobody in here knows where the run ends
    # a run is decided by the symbols before and after it too
    lo, hi = s.lo[np.maximum(head - 1, 0)], s.hi[np.minimum(tail + 1, n - 1)]
    run = s.name[head] * U64(window + 1) + np.minimum(size, window).astype(U64)
    shut |= size > window
    left = (mix(run ^ mix(np.full(1, level, U64))) & U64(1)) == 0
    pair = np.flatnonzero(left[:-1] & ~left[1:] & ~gap[1:])
    second = np.zeros(len(run), bool)
    second[pair + 1] = True
    paired = second.copy()
    paired[pair] = True
    # a lone left run was decided by what follows it, a lone right one by what precedes it
    after, before = np.minimum(np.arange(len(run)) + 1, len(run) - 1), np.maximum(np.arange(len(run)) - 1, 0)
    lone_l, lone_r = ~paired & left, ~paired & ~left
    lo2, hi2 = np.where(lone_r, lo[before], lo), np.where(lone_l, hi[after], hi)
    shut2 = shut | (lone_l & shut[after]) | (lone_r & shut[before])
    hi2[pair], shut2[pair] = hi[pair + 1], shut[pair] | shut[pair + 1]
    b = np.zeros(len(run), U64)
    b[pair] = run[pair + 1]
    a = np.where((b == 0) & (size == 1), U64(0), run)
    keep = ~second
    hi2[shut2] = lo2[shut2] + window + 1  # fits no window
    return Symbols(s.name[head][keep], lo2[keep], hi2[keep], gap[keep]), a[keep], b[keep]


def combine_fitting(s: Symbols, level: int, alive: Alive) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """What combine() makes that still fits a window that may repeat, some stretches between gaps at a time: none depends on another."""
    cuts = np.flatnonzero(s.gap)
    at = np.searchsorted(cuts, np.arange(COMBINED, len(s.name), COMBINED))
    edges = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]], [len(s.name)]])).tolist()
    parts = []
    for i, j in zip(edges[:-1], edges[1:]):
        new, a, b = combine(Symbols(s.name[i:j], s.lo[i:j], s.hi[i:j], s.gap[i:j]), level, alive.window)
        keep = alive.around(new.lo, new.hi)
        new = new.pick(keep)
        parts.append((new.name, new.lo, new.hi, new.gap, a[keep], b[keep]))
    name, lo, hi, gap, a, b = (np.concatenate(c) for c in zip(*parts)) if parts else (s.name, s.lo, s.hi, s.gap, np.zeros(0, U64), np.zeros(0, U64))
    return Symbols(name, lo, hi, gap), a, b


def distinct(a: np.ndarray, b: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) by owner, a, b: owner, a, b, and the number of each given pair."""
    owner = (mix(a * U64(0x9E3779B97F4A7C15) ^ mix(b)) % U64(owners)).astype(np.int64)
    order = np.lexsort((b, a, owner))
    o, x, y = owner[order], a[order], b[order]
    head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(a) else np.zeros(0, np.int64)
    of = np.empty(len(a), np.int64)
    of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(a))))
    return o[head], x[head], y[head], of


def spans(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Owner, start and end of each stretch of one owner."""
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    yield from zip(owner[heads].tolist(), heads.tolist(), np.append(heads[1:], len(owner)).tolist())


def several(of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which of n things two ids have; ids must be sorted."""
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[of[::-1]], high[of] = ids[::-1], ids
    return low != high


class Level:
    """A block's symbols of a level that wait for their names, and the windows that may repeat."""

    def __init__(self, s: Symbols, alive: Alive, ids: np.ndarray, level: int, owners: int):
        """ids: the document id of every word."""
        self.alive, self.level = alive, level
        self.symbols, a, b = combine_fitting(s, level, alive)
        self.fresh = np.flatnonzero(a)
        self.owner, self.a, self.b, self.of = distinct(a[self.fresh], b[self.fresh], owners)
        self.shared = several(self.of, ids[self.symbols.lo[self.fresh]], len(self.a))

    def ask(self, block: int) -> list[M.Row]:
        return [(o, KEYS, block, self.level, 0, [M.pack_sorted(self.a[i:j]), M.pack(self.b[i:j]), M.bits(self.shared[i:j])]) for o, i, j in spans(self.owner)]

    def hear(self, told: list[M.Row]) -> tuple[Symbols, Alive]:
        """Named symbols that still fit a window, and the windows no private symbol rules out."""
        named = {r[2]: r[5] for r in told}
        names = np.zeros(len(self.a), U64)
        for o, i, j in spans(self.owner):
            has = M.unbits(named[o][0], j - i)
            names[i:j][has] = M.unpack_sorted(named[o][1])
        s = self.symbols
        s.name = s.name.copy()
        s.name[self.fresh] = names[self.of]
        out = s.name == 0
        alive = self.alive.without(s.lo[out], s.hi[out])
        return s.pick(~out & alive.around(s.lo, s.hi)), alive


def name_keys(owner: int, asked: list[M.Parts], owners: int, level: int, levels: int) -> list[tuple[int, int, M.Parts]]:
    """Names of the keys that two documents have, by comparing the keys."""
    a, b = np.concatenate([M.unpack_sorted(p[0]) for p in asked]), np.concatenate([M.unpack(p[1], U64) for p in asked])
    sizes = [len(M.unpack(p[0], U64)) for p in asked]
    own = np.concatenate([M.unbits(p[2], n) for p, n in zip(asked, sizes)])
    _, x, _, of = distinct(a, b, 1)
    shared = np.bincount(of, 1 + own, len(x)) > 1
    names = ((np.cumsum(shared) - 1) * owners + owner + 1) * levels + level
    out, at = [], 0
    for n in sizes:
        mine = of[at : at + n]
        has = shared[mine]
        out.append((0, 0, [M.bits(has), M.pack_sorted(names[mine[has]].astype(U64))]))
        at += n
    return out


def name_words(owner: int, asked: list[M.Parts], owners: int, levels: int) -> list[tuple[int, int, M.Parts]]:
    """Names of the words that two documents have, by comparing the words; zero for others."""
    index, of, own = T.Numbered(), [], []
    for p in asked:
        words = T.read_words(p)
        of.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        own.append(M.unpack(p[1], np.uint8))
    shared = np.bincount(np.concatenate(of), 1 + np.concatenate(own), len(index)) > 1
    names = np.where(shared, ((np.cumsum(shared) - 1) * owners + owner + 1) * levels, 0).astype(U64)
    return [(0, 0, [p[0], M.pack(names[x])]) for p, x in zip(asked, of)]


class Words:
    """A block with the names of its words."""

    def __init__(self, mail: M.Mail, window: int):
        self.block = T.Block(mail.one(T.BASE))
        names = np.zeros(self.block.distinct, U64)
        for r in mail[NAMES]:
            names[M.unpack_sorted(r[5][0], np.uint32)] = M.unpack(r[5][1], U64)
        self.name = names[self.block.tokens]
        self.ids = np.repeat(self.block.ids, self.block.sizes)
        self.alive = windows_of(self.name == 0, self.block.ends, window)
        gap = np.zeros(len(self.name) + 1, bool)
        gap[0] = gap[self.block.ends] = True
        at = np.flatnonzero(self.alive.words())
        self.symbols = Symbols(self.name[at], at, at + 1, gaps_between(gap[:-1], at))


class Covered:
    """What a block keeps of its words: the names inside windows that may repeat."""

    def __init__(self, parts: M.Parts, alive: M.Parts, window: int):
        sizes, self.ids_of = M.unpack(parts[2], np.uint32).astype(np.int64), M.unpack(parts[3], np.int64)
        n = int(sizes.sum())
        self.name = np.zeros(n, U64)
        self.name[M.unbits(parts[0], n)] = M.unpack(parts[1], U64)
        self.ids = np.repeat(self.ids_of, sizes)
        self.alive = Alive(M.unbits(alive[0], n), window)

    @staticmethod
    def parts(words: Words, alive: Alive) -> M.Parts:
        in_ = alive.words()
        return [M.bits(in_), M.pack(words.name[in_]), M.pack(words.block.sizes.astype(np.uint32)), M.pack(words.block.ids)]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The names of the windows at these places, a row each."""
        return self.name[at[:, None] + np.arange(self.alive.window)]


class Repeats:
    """A block's windows by hash: each hash has a leader, the first window of the smallest document, and those equal to it."""

    def __init__(self, c: Covered, hash_bits: int):
        self.c = c
        at = np.flatnonzero(c.alive.flags)
        h = np.zeros(len(at), U64)
        for i in range(c.alive.window):
            h = mix(h * U64(0x9E3779B97F4A7C15) + c.name[at + i])
        h = mix(h) >> U64(64 - hash_bits)
        order = np.argsort(h, kind="stable")  # documents are in the order of their ids, so are windows
        self.at, h = at[order], h[order]
        self.head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(self.head)), np.diff(np.append(self.head, len(h))))
        self.hash, self.lead = h[self.head], self.at[self.head]
        self.odd = np.zeros(len(h), bool)
        follow = np.flatnonzero(np.concatenate([[False], h[1:] == h[:-1]]))
        for i in range(c.alive.window):
            self.odd[follow] |= c.name[self.at[follow] + i] != c.name[self.lead[self.of[follow]] + i]

    def owner(self, owners: int) -> np.ndarray:
        return (mix(self.hash) % U64(owners)).astype(np.int64)

    def ask(self, block: int, owners: int) -> list[M.Row]:
        return [(o, ASK, block, 0, 0, [M.pack_sorted(self.hash[x]), M.pack(self.c.ids[self.lead[x]]), M.pack(self.lead[x].astype(np.uint32))]) for o, x in M.by_owner(self.owner(owners))]

    def hear(self, told: list[M.Row], owners: int) -> None:
        """Where each leader's window is said to stand first: block (-1: here) and place, and whether the document there is smaller."""
        self.block, self.place, self.less = np.full(len(self.lead), -1), np.zeros(len(self.lead), np.int64), np.zeros(len(self.lead), bool)
        parts = {r[2]: r[5] for r in told}
        for o, x in M.by_owner(self.owner(owners)):
            p = parts[o]
            known = M.unbits(p[0], len(x))
            self.block[x[known]], self.place[x[known]] = M.unpack(p[1], np.int64), M.unpack(p[2], np.uint32)
            self.less[x] = M.unbits(p[3], len(x))

    def gone(self, bad: np.ndarray | None = None) -> np.ndarray:
        """Places of windows that repeat one of a smaller document, without those that are odd or whose leader is bad."""
        ids = self.c.ids
        less = self.less[self.of] | (ids[self.lead[self.of]] < ids[self.at])
        return self.at[less & ~self.odd & (True if bad is None else ~bad[self.of])]

    def claims(self, block: int) -> list[M.Row]:
        """Stretches of leaders that are said to repeat a stretch of another block: to that block, with the names."""
        x = np.flatnonzero(self.block >= 0)
        x = x[np.argsort(self.lead[x], kind="stable")]
        at, to, place = self.lead[x], self.block[x], self.place[x]
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(to) != 0)]) if len(x) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(x))) + self.c.alive.window - 1
        return [(t, CLAIM, block, p, i, [M.pack(self.c.name[i : i + n])]) for t, p, i, n in zip(to[head].tolist(), place[head].tolist(), at[head].tolist(), size.tolist())]

    def settle_odd(self, block: int, bad: np.ndarray) -> list[M.Row]:
        """Windows whose hash met a different window, with their names."""
        at = self.at[self.odd | bad[self.of]]
        return [(0, ODD, block, d, i, [w.tobytes()]) for d, i, w in zip(self.c.ids[at].tolist(), at.tolist(), self.c.windows(at))]


def first_of(asked: list[M.Parts], sources: list[int]) -> list[tuple[int, int, M.Parts]]:
    """For each hash asked about that another block has too and that does not stand first here: block and place of the first, and whether it is in a smaller document."""
    hs = [M.unpack_sorted(p[0]) for p in asked]
    sizes = [len(h) for h in hs]
    h, ids, at = np.concatenate(hs), np.concatenate([M.unpack(p[1], np.int64) for p in asked]), np.concatenate([M.unpack(p[2], np.uint32) for p in asked])
    source = np.repeat(np.array(sources, np.int64), sizes)
    order = np.lexsort((source, ids, h))  # a block asks once about a hash
    s = h[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    lead = np.empty(len(h), np.int64)
    lead[order] = np.repeat(order[head], np.diff(np.append(head, len(h))))
    known, less = lead != np.arange(len(h)), ids[lead] < ids
    out, i = [], 0
    for n in sizes:
        k = known[i : i + n]
        to = lead[i : i + n][k]
        out.append((0, 0, [M.bits(k), M.pack(source[to]), M.pack(at[to]), M.bits(less[i : i + n])]))
        i += n
    return out


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", hash_bits: int | None = None, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept (the text that remains).

    A word goes if a window of consecutive words that covers it also starts in a document with a smaller
    doc_id. What is kept is joined by single spaces. Null, empty and blank texts have no words; texts
    shorter than a window lose nothing. Rows that repeat a doc_id are one document and take nothing from
    each other; a null id ranks with the largest id there is, and rows without id take nothing from each
    other. An empty table gives an empty result; other columns are ignored.
    """
    hash_bits = HASH_BITS if hash_bits is None else hash_bits
    owners = M.owners_for(T.text_bytes(docs, text_col), docs.sparkSession)
    levels = window + 1

    def tell(b: T.Block, n: int) -> np.ndarray:
        return several(b.tokens.astype(np.int64), np.repeat(b.ids, b.sizes), n).astype(np.uint8)

    cut = materialize(T.cut(docs, owners, tell, id_col, text_col, block_bytes=block_bytes), "words")
    base = cut.where(F.col("kind") == T.BASE)
    words = M.settle(cut.where(F.col("kind") == T.WORDS), owners, NAMES, lambda o, _, asked: name_words(o, asked, owners, levels))

    def ask_first(block: int, mail: M.Mail) -> pa.Table:
        w = Words(mail, window)
        return M.table(Level(w.symbols, w.alive, w.ids, 1, owners).ask(block))

    def after_first(block: int, mail: M.Mail) -> pa.Table:
        w = Words(mail, window)
        symbols, alive = Level(w.symbols, w.alive, w.ids, 1, owners).hear(mail[KEY_NAMES])
        rows = Level(symbols, alive, w.ids, 2, owners).ask(block)
        return M.table([(block, COVERED, block, 0, 0, Covered.parts(w, alive)), (block, STATE, block, 0, 0, [M.bits(alive.flags), *symbols.parts()]), *rows])

    def namer(level: int) -> Callable:
        return lambda o, _, asked: name_keys(o, asked, owners, level, levels)

    keys = M.settle(M.visit_with(base, words, ask_first), owners, KEY_NAMES, namer(1))
    state = materialize(M.visit_with(base, words.unionByName(keys), after_first), "level")
    covered = state.where(F.col("kind") == COVERED)
    for level in range(2, levels):  # a symbol of level t is decided by more than t words
        if state.where(F.col("kind") == KEYS).isEmpty():
            break

        def after(block: int, mail: M.Mail, level: int = level) -> pa.Table:
            c = Covered(mail.one(COVERED), (p := mail.one(STATE))[:1], window)
            symbols, alive = Level(Symbols.of(p[1:]), c.alive, c.ids, level, owners).hear(mail[KEY_NAMES])
            rows = Level(symbols, alive, c.ids, level + 1, owners).ask(block) if level + 1 < levels else []
            return M.table([(block, STATE, block, 0, 0, [M.bits(alive.flags), *symbols.parts()]), *rows])

        named = M.settle(state.where(F.col("kind") == KEYS), owners, KEY_NAMES, namer(level))
        state = materialize(M.visit(covered.unionByName(state.where(F.col("kind") == STATE)).unionByName(named), after), "level")
    kept = covered.unionByName(state.where(F.col("kind") == STATE).withColumn("parts", F.slice("parts", 1, 1)))

    def met(mail: M.Mail) -> Repeats:
        return Repeats(Covered(mail.one(COVERED), mail.one(STATE), window), hash_bits)

    def ask_windows(block: int, mail: M.Mail) -> pa.Table:
        return M.table(met(mail).ask(block, owners))

    def claim(block: int, mail: M.Mail) -> pa.Table:
        r = met(mail)
        r.hear(mail[FIRST], owners)
        odd = r.settle_odd(block, np.zeros(len(r.lead), bool)) if r.odd.any() else []
        return M.table([(block, GONE, block, 0, 0, [M.pack_sorted(np.sort(r.gone()).astype(np.uint32))]), *r.claims(block), *odd])

    first = M.settle(M.visit(kept, ask_windows), owners, FIRST, lambda o, sources, asked: first_of(asked, sources))
    said = materialize(M.visit_with(kept, first, claim), "repeats")
    claims, odd = said.where(F.col("kind") == CLAIM), said.where(F.col("kind") == ODD)

    def verify(block: int, mail: M.Mail) -> pa.Table:
        c, out = Covered(mail.one(COVERED), mail.one(STATE), window), []
        for r in mail[CLAIM]:
            names = M.unpack(r[5][0], U64)
            if not np.array_equal(names, c.name[r[3] : r[3] + len(names)]):
                at = np.arange(r[3], r[3] + len(names) - window + 1)
                out.append((block, BAD, 0, r[3], 0, r[5]))
                out += [(0, ODD, block, d, i, [w.tobytes()]) for d, i, w in zip(c.ids[at].tolist(), at.tolist(), c.windows(at))]
        return M.table(out)

    alike = claims.groupBy("dest", "kind", "a", "parts").agg(F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("b")).select(*claims.columns)
    bad = materialize(M.visit_with(kept.join(alike.select("dest").distinct(), "dest", "left_semi").select(*kept.columns), alike, verify), "unverified")
    gone = said.where(F.col("kind") == GONE)
    if not bad.isEmpty() or not odd.isEmpty():
        gone = gone.unionByName(settled(kept, first, claims, odd, bad, met, owners))

    def end(block: int, mail: M.Mail) -> pa.Table:
        b = T.Block(mail.one(T.BASE))
        words_ = T.spell(mail[T.WORDS], b.distinct)
        keep = {}
        for r in mail[GONE]:
            keep[r[3]] = M.unpack_sorted(r[5][0], np.uint32)
        at = keep.get(0, np.zeros(0, np.uint32))
        if 1 in keep:  # places once said to repeat that names do not bear out, and places that names settle
            at = np.setdiff1d(at, keep[1])
        if 2 in keep:
            at = np.union1d(at, keep[2])
        out = M.cover(at, window, len(b.tokens))
        rows, lo = [], 0
        removed = np.add.reduceat(np.append(out, False).astype(np.int64), b.ends - b.sizes) * (b.sizes > 0)
        for d, null, n, gone_ in zip(b.ids.tolist(), b.null.tolist(), b.sizes.tolist(), removed.tolist()):
            left = b.tokens[lo : lo + n][~out[lo : lo + n]] if gone_ else b.tokens[lo : lo + n]
            text = b" ".join(map(words_.__getitem__, left.tolist()))
            rows.append((None if null else d, n, gone_, hashlib.sha256(text).hexdigest(), text))
            lo += n
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    spelt = cut.where(F.col("kind") == T.WORDS).withColumns({"dest": F.col("source"), "source": F.col("dest")})
    out = M.visit(cut.where(F.col("kind") == T.BASE).unionByName(spelt).unionByName(gone), end, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def settled(kept: DataFrame, first: DataFrame, claims: DataFrame, odd: DataFrame, bad: DataFrame, met, owners: int) -> DataFrame:
    """GONE rows that correct the others: a = 1, places that are not borne out; a = 2, places that repeat by their names themselves."""
    wrong = claims.join(bad.where(F.col("kind") == BAD).select("dest", "a", "parts"), ["dest", "a", "parts"], "left_semi").select(F.col("source").alias("dest"), F.lit(BAD).alias("kind"), F.lit(0).cast("long").alias("source"), F.col("b").alias("a"), F.lit(0).cast("long").alias("b"), "parts")
    touched = materialize(wrong.unionByName(odd.select(F.col("source").alias("dest"), F.lit(BAD).alias("kind"), F.lit(0).cast("long").alias("source"), F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<binary>").alias("parts")).distinct()), "collisions")

    def again(block: int, mail: M.Mail) -> pa.Table:
        r = met(mail)
        r.hear(mail[FIRST], owners)
        bad_ = np.zeros(len(r.lead), bool)
        for row in mail[BAD]:
            if row[3] >= 0:
                n = len(M.unpack(row[5][0], U64)) - r.c.alive.window + 1
                bad_ |= (r.lead >= row[3]) & (r.lead < row[3] + n) & (r.block >= 0)
        lost = np.setdiff1d(r.gone(), r.gone(bad_))
        return M.table([(block, GONE, block, 1, 0, [M.pack_sorted(lost.astype(np.uint32))]), *r.settle_odd(block, bad_)])

    here = touched.select("dest").distinct()
    base = kept.join(here, "dest", "left_semi").select(*kept.columns)
    rows = first.join(here, "dest", "left_semi").select(*first.columns).unionByName(touched)
    found = materialize(M.visit_with(base, rows, again), "settled")
    by_names = found.unionByName(bad).where(F.col("kind") == ODD).withColumn("least", F.min("a").over(Window.partitionBy("parts"))).where("a > least")

    def places(block: int, mail: M.Mail) -> pa.Table:
        at = np.unique(np.array([r[4] for r in mail[ODD]], np.uint32))
        return M.table([(block, GONE, block, 2, 0, [M.pack_sorted(at)])])

    again_gone = M.visit(by_names.select(F.col("source").alias("dest"), "kind", "source", "a", "b", "parts"), places)
    return found.where(F.col("kind") == GONE).unionByName(again_gone)
