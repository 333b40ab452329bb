"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every 50-byte window names an anchor: the leftmost gram with the least hash inside it, which the window's
bytes alone decide. Windows whose anchor no other document has can't repeat and go no further. Of the others,
a hash of the bytes around the anchor goes to its owner, which tells where these bytes are said to stand first.
Every stretch that is said to stand elsewhere is verified there, byte by byte; should a hash ever have lied, the
whole runs again with another salt. Where an anchor has several contexts, one document of each sends its bytes, and
those windows whose hash comes up twice are sorted as suffixes: a merge sort whose comparisons find the common
extension by binary search over prefix polynomial hashes. Neighbours that agree on 50 bytes are compared byte by
byte before they count as equal, and the smallest doc_id of a window's class decides what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F, types as T

from termwright.llm import repeats as R
from termwright.llm.repeats import NO_ID, U64, Powers, mix
from termwright.llm.runtime import materialize, partitions

GRAM = 20
#: Windows sorted at once.
SORTED = 1 << 18
#: Bytes whose grams are hashed at once; a longer text is hashed in parts that overlap by a window.
PART = 1 << 17
#: Bits of a context's hash at first; tests make it small.
HASH_BITS = 48
SHARED, JUDGED, RANGES, CLAIMS = range(4)


def anchors(texts: list[bytes], window: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, in order: text, first window, number of windows, hash of the anchor's gram."""
    out: list[tuple] = []
    held, size = [], 0

    def flush() -> None:
        if not held:
            return
        text, base = np.array([i for i, _, _ in held]), np.array([b for _, b, _ in held])
        n = np.array([len(t) for _, _, t in held])
        buf = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        part = np.repeat(np.arange(len(held)), n)
        ends = np.cumsum(n)
        grams = len(buf) - gram + 1
        p = powers.prefix(buf)
        g = mix((p[gram:] - p[:-gram]) * powers.down[:grams])
        low = (g * U64(0x9E3779B97F4A7C15) & ~U64((1 << 22) - 1)) | np.arange(grams, dtype=U64)
        wide = window - gram + 1
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if wide > span:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        at = np.flatnonzero(np.arange(len(low)) + window <= ends[part[: len(low)]])
        if len(at):
            q = (low[at] & U64((1 << 22) - 1)).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (part[at[1:]] != part[at[:-1]])]))
            first, p = at[head], part[at[head]]
            out.append((text[p], first - (ends - n)[p] + base[p], np.diff(np.append(head, len(at))), g[q[head]]))
        held.clear()

    for i, t in enumerate(texts):
        step = PART - window + 1
        for b in range(0, max(1, len(t) - window + 1), step):
            part = t[b : b + PART]
            if len(part) >= window:
                held.append((i, b, part))
                size += len(part)
                if size >= PART:
                    flush()
                    size = 0
    flush()
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64))
    return tuple(np.concatenate(c) for c in zip(*out))


def common(buf: np.ndarray, prefix: np.ndarray, powers: Powers, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common extension of two suffixes, up to `most`, by binary search over hashes."""
    found = np.zeros(len(a), np.int64)
    step = 1 << most.bit_length() - 1
    while step:
        size = found + step
        fits = np.flatnonzero(size <= most)
        x, y, n = a[fits], b[fits], size[fits]
        same = powers.at(prefix, x, n) == powers.at(prefix, y, n)
        found[fits[same]] = n[same]
        step //= 2
    return found


def suffix_sort(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """Order of the suffixes by group and then by their first `window` bytes; group must be sorted. A stable bottom-up merge sort, all groups in step."""
    prefix = powers.prefix(buf)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(heads, len(group)))
    base, total = np.repeat(heads, size), np.repeat(size, size)
    order = np.arange(len(starts))
    width = 1
    while width < size.max(initial=0):
        act = np.flatnonzero(total > width)  # places of groups that still merge
        place = act - base[act]
        run = place // width
        left = run % 2 == 0
        other = (run ^ 1) * width
        end = np.minimum(other + width, total[act])
        lo, hi = np.minimum(other, total[act]), np.maximum(end, np.minimum(other, total[act]))
        first = lo.copy()
        me = starts[order[act]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            it = starts[order[base[act[open_]] + mid]]
            mine = me[open_]
            n = common(buf, prefix, powers, it, mine, window)
            edge = n >= window
            # the run on the left goes first among equals
            x, y = buf[np.where(edge, it, it + n)], buf[np.where(edge, mine, mine + n)]
            before = np.where(edge, ~left[open_], x < y)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        own = place - run * width
        to = base[act] + np.minimum(run, run ^ 1) * width + own + (lo - first)
        new = order.copy()
        new[to] = order[act]
        order = new
        width *= 2
    return order


def classes(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """Class number of each suffix's first `window` bytes within its group."""
    order = suffix_sort(buf, starts, group, window, powers)
    s, g = starts[order], group[order]
    near = np.flatnonzero(g[1:] == g[:-1])
    prefix = powers.prefix(buf)
    same = near[powers.at(prefix, s[near], window) == powers.at(prefix, s[near + 1], window)]
    lane = np.arange(window)
    if not all((buf[s[x][:, None] + lane] == buf[s[x + 1][:, None] + lane]).all() for x in np.array_split(same, max(1, len(same) // 20000 + 1))):
        # two different strings with one hash: sort this lot by its bytes instead
        rows = np.concatenate([group[:, None].astype(">i8").view(np.uint8), buf[starts[:, None] + lane]], axis=1)
        return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    new = np.ones(len(s), bool)
    new[same + 1] = False
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def twins(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """As classes(): windows whose hash is alone in their group are alone; only the others need the sort."""
    h = mix(powers.at(powers.prefix(buf), starts, window) + mix(group.astype(U64)))
    order = np.argsort(h)
    s = h[order]
    apart = np.concatenate([[True], s[1:] != s[:-1], [True]])
    maybe = np.zeros(len(h), bool)
    maybe[order] = ~(apart[:-1] & apart[1:])
    out = np.arange(len(h)) + len(h)
    at = np.flatnonzero(maybe)
    if len(at):
        out[at] = classes(buf, starts[at], group[at], window, powers)
    return np.unique(out, return_inverse=True)[1].reshape(-1)


def contexts_classes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, powers: Powers) -> np.ndarray:
    """Class number of equal (key, bytes), verified."""
    prefix = powers.prefix(buf)
    h = mix(powers.at(prefix, start, size) + size.astype(U64)) ^ mix(key)
    _, first, cls = np.unique(h, return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    lead = first[cls]
    x = np.flatnonzero(lead != np.arange(len(lead)))
    y = lead[x]
    if ((size[x] != size[y]) | (key[x] != key[y])).any() or (buf[R.flat(start[x], size[x])] != buf[R.flat(start[y], size[y])]).any():
        raw = buf.tobytes()
        names: dict = {}
        return np.array([names.setdefault((k, raw[s : s + n]), len(names)) for k, s, n in zip(key.tolist(), start.tolist(), size.tolist())])
    return cls


class Contexts:
    """A block's runs of windows with one anchor and, once owners have told which anchors are shared, the classes of their contexts."""

    def __init__(self, block: R.Block, window: int, gram: int):
        self.block, self.window = block, window
        self.powers = Powers()
        self.text, self.first, self.wins, self.key = anchors(block.texts, window, gram, self.powers)
        self.anchors = R.Keys(self.key, block.ids[self.text])

    def hear(self, told: R.Told, count: int) -> Contexts:
        known = self.anchors.hear(told, count)
        pick = np.flatnonzero(known.shared[known.of])
        text, first, wins, key, hot = self.text[pick], self.first[pick], self.wins[pick], self.key[pick], known.hot[known.of[pick]]
        n = np.array([len(t) for t in self.block.texts])
        base = np.cumsum(n) - n
        self.buf = np.frombuffer(b"".join(self.block.texts), np.uint8)
        if hot.any():  # one window each, owned by its own bytes
            w = wins[hot]
            t2, f2 = np.repeat(text[hot], w), R.flat(first[hot], w)
            own = mix(self.powers.at(self.powers.prefix(self.buf), base[t2] + f2, self.window))
            text, first = np.concatenate([text[~hot], t2]), np.concatenate([first[~hot], f2])
            wins, key = np.concatenate([wins[~hot], np.ones(len(t2), np.int64)]), np.concatenate([key[~hot], own])
        self.start, self.size = base[text] + first, wins + self.window - 1
        self.cls = contexts_classes(self.buf, self.start, self.size, key, self.powers)
        self.ids = self.block.ids[text]
        # the smallest document of a class stands for it
        order = np.lexsort((self.start, self.ids, self.cls))
        self.lead = order[np.flatnonzero(np.diff(self.cls[order], prepend=-1))]
        line = np.argsort(key[self.lead], kind="stable")
        self.lead = self.lead[line]
        number = np.empty(len(line), np.int64)
        number[line] = np.arange(len(line))
        self.cls = number[self.cls]
        self.names, self.least = key[self.lead], self.ids[self.lead]
        return self

    def hashes(self, salt: int, hash_bits: int) -> np.ndarray:
        start, size = self.start[self.lead], self.size[self.lead]
        h = mix(mix(self.powers.at(self.powers.prefix(self.buf), start, size) + size.astype(U64)) + U64(salt))
        return h >> U64(64 - hash_bits)

    def judged(self, told: R.Told, count: int) -> Contexts:
        """With what the owners made of the contexts' hashes: who is in a smaller document whole, who speaks, and where each is said to stand first."""
        n = len(self.names)
        self.whole, self.speaks, self.to, self.place = np.zeros(n, bool), np.zeros(n, bool), np.full(n, -1), np.zeros(n, np.int64)
        for owner, x in R.by_owner(self.names, count):
            whole, speaks, elsewhere, to, place = told[JUDGED, owner]
            self.whole[x], self.speaks[x] = R.unbits(whole, len(x)), R.unbits(speaks, len(x))
            at = x[R.unbits(elsewhere, len(x))]
            self.to[at], self.place[at] = R.unplanes(to, np.int32), R.unplanes(place, np.uint32)
        return self

    def claims(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches said to stand in another block: that block, the place there, the place here, and the bytes."""
        x = np.flatnonzero(self.to >= 0)
        x = x[np.argsort(self.start[self.lead[x]], kind="stable")]
        here, size, to, there = self.start[self.lead[x]], self.size[self.lead[x]], self.to[x], self.place[x]
        ends = here + size
        # contexts that follow on each other, here as there, are one stretch
        new = np.concatenate([[True], (here[1:] > ends[:-1]) | (to[1:] != to[:-1]) | (np.diff(there) != np.diff(here))]) if len(x) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(x)) - 1
        return to[head], there[head], here[head], (ends[tail] - here[head] if len(x) else ends)

    def speakers(self, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each owner and the contexts whose bytes it must see."""
        at = np.flatnonzero(self.speaks)
        for owner, x in R.by_owner(self.names[at], count):
            yield owner, at[x]


def six(h: np.ndarray) -> bytes:
    """Hashes of at most 48 bits, six bytes each."""
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).reshape(-1)


def own_hashes(blocks: list[int], asked: list[R.Parts]) -> list[tuple[int, int, R.Parts]]:
    """Which contexts a smaller document of another block has whole, which speak for their class where an anchor has several, and for those that do not stand first: the block and place of the first."""
    names = [R.unsteps(p[0]) for p in asked]
    sizes, keys = list(map(len, names)), np.concatenate(names)
    h = np.concatenate([unsix(p[1]) for p in asked])
    least, place = np.concatenate([R.unplanes(p[2], np.int64) for p in asked]), np.concatenate([R.unplanes(p[3], np.uint32) for p in asked])
    block = np.repeat(np.array(blocks, np.int32), sizes)
    order = np.lexsort((least, h, keys))  # blocks ask in order, and a block asks once about a context
    k = keys[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    new = new_key.copy()
    new[1:] |= h[order[1:]] != h[order[:-1]]
    heads = np.flatnonzero(new)
    lead = np.empty(len(k), np.int64)
    lead[order] = np.repeat(order[heads], np.diff(np.append(heads, len(k))))
    anchor = np.cumsum(new_key) - 1
    several = np.zeros(len(k), bool)
    several[order] = np.bincount(anchor, new)[anchor] > 1 if len(k) else False
    whole, elsewhere = least[lead] < least, lead != np.arange(len(k))
    speaks = several & ~whole
    out, at = [], 0
    for b, n in zip(blocks, sizes):
        mine = slice(at, at + n)
        to = lead[mine][elsewhere[mine]]
        out.append((b, JUDGED, [R.bits(whole[mine]), R.bits(speaks[mine]), R.bits(elsewhere[mine]), R.planes(block[to]), R.planes(place[to])]))
        at += n
    return out


def own_claims(asked: list[R.Parts]) -> list[tuple[int, int, R.Parts]]:
    """Claims on, each different one once, to the blocks they are about."""
    seen: dict[int, dict[tuple[int, bytes], None]] = {}
    for p in asked:
        if not p[4]:
            continue
        to, place, size = R.unplanes(p[4], np.int32).tolist(), R.unplanes(p[5], np.uint32).tolist(), R.unplanes(p[6], np.uint32).tolist()
        raw, at = zstd.ZstdDecompressor().decompress(p[7]), 0
        for t, i, n in zip(to, place, size):
            seen.setdefault(t, {})[i, raw[at : at + n]] = None
            at += n
    out = []
    for t, claims in seen.items():
        place, size = np.array([i for i, _ in claims], np.uint32), np.array([len(x) for _, x in claims], np.uint32)
        out.append((t, CLAIMS, [R.planes(place), R.planes(size), zstd.ZstdCompressor(level=1).compress(b"".join(x for _, x in claims))]))
    return out


def borne_out(buf: np.ndarray, claims: list[R.Parts]) -> bool:
    """Whether all the claims' bytes stand where they are said to."""
    for p in claims:
        place, size = R.unplanes(p[0], np.uint32).astype(np.int64), R.unplanes(p[1], np.uint32).astype(np.int64)
        raw = np.frombuffer(zstd.ZstdDecompressor().decompress(p[2]), np.uint8)
        if (place + size > len(buf)).any() or not np.array_equal(buf[R.flat(place, size)], raw):
            return False
    return True


def own_contexts(blocks: list[int], asked: list[R.Parts], window: int) -> list[tuple[int, int, R.Parts]]:
    """Claims on to their blocks; which contexts a smaller document of another block has whole, and the ranges of others whose windows a smaller document has."""
    powers, expand = Powers(), zstd.ZstdDecompressor().decompress
    body = np.frombuffer(b"".join(expand(p[0]) for p in asked), np.uint8)
    sizes, keys, least = (np.concatenate([f(p[i]) for p in asked]) for i, f in ((1, lambda x: R.unplanes(x, np.uint32).astype(np.int64)), (2, R.unsteps), (3, lambda x: R.unplanes(x, np.int64))))
    ends = np.cumsum([len(R.unplanes(p[1], np.uint32)) for p in asked])
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    k, sz, st, ids = keys[order], sizes[order], starts[order], least[order]
    wins = np.cumsum(sz - window + 1)
    whole = np.zeros(len(k), bool)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    lo = 0
    while lo < len(k):  # whole keys, about SORTED windows at a time
        hi = int(np.searchsorted(wins, (wins[lo - 1] if lo else 0) + SORTED, side="right"))
        hi = int(np.searchsorted(k, k[min(max(hi, lo + 1), len(k)) - 1], side="right"))
        size = sz[lo:hi]
        buf = body[R.flat(st[lo:hi], size)]
        start = np.cumsum(size) - size
        cls = contexts_classes(buf, start, size, k[lo:hi], powers)
        n_cls = cls.max() + 1
        first = np.full(n_cls, hi, np.int64)
        np.minimum.at(first, cls, np.arange(hi - lo))
        low = np.full(n_cls, NO_ID, np.int64)
        np.minimum.at(low, cls, ids[lo:hi])
        over = ids[lo:hi] > low[cls]
        whole[order[lo:hi]] = over
        # keys with several classes: sort the windows of one context of each class
        one = np.sort(first)
        key_of = np.unique(k[lo:hi][one], return_inverse=True)[1].reshape(-1)
        many = np.bincount(key_of)[key_of] > 1
        one, key_of = one[many], key_of[many]
        if len(one):
            w = size[one] - window + 1
            owner = np.repeat(one, w)
            at = R.flat(start[one], w)
            group = np.repeat(key_of, w)
            line = np.argsort(group, kind="stable")
            same = twins(buf, at[line], group[line], window, powers)
            mine = low[cls[owner]]
            best = np.full(same.max() + 1, NO_ID, np.int64)
            np.minimum.at(best, same, mine[line])
            worse = np.zeros(len(at), bool)
            worse[line] = best[same] < mine[line]
            # the smallest document of a class loses the windows that a smaller one has elsewhere
            head = np.flatnonzero(worse & ~np.concatenate([[False], worse[:-1] & (owner[1:] == owner[:-1])]))
            tail = np.flatnonzero(worse & ~np.concatenate([worse[1:] & (owner[1:] == owner[:-1]), [False]]))
            if len(head):
                scls, off, ln = cls[owner[head]], at[head] - start[owner[head]], tail - head + window
                holds = np.flatnonzero(~over)
                holds = holds[np.argsort(cls[holds], kind="stable")]
                a, b = np.searchsorted(cls[holds], scls), np.searchsorted(cls[holds], scls, side="right")
                got.append((order[lo + holds[R.flat(a, b - a)]], np.repeat(off, b - a), np.repeat(ln, b - a)))
        lo = hi
    ctx, off, ln = (np.concatenate(x) for x in zip(*got))
    line = np.argsort(ctx, kind="stable")
    ctx, off, ln = ctx[line], off[line], ln[line]
    out, lo = own_claims(asked), 0
    for block, hi in zip(blocks, ends.tolist()):
        a, b = np.searchsorted(ctx, [lo, hi])
        out.append((block, RANGES, [R.bits(whole[lo:hi]), *(R.planes(x.astype(np.uint32)) for x in (ctx[a:b] - lo, off[a:b], ln[a:b]))]))
        lo = hi
    return out


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, carry: list[str] | None = None, as_text: bool = False, hash_bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, h (hash of the text), n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Columns named in carry come along in a struct `carry`. With as_text, kept is a string without the rests of
    characters that a cut splits.

    A byte goes if a `window`-byte string that covers it also starts in a document with a smaller doc_id.
    A null text counts as empty. Texts shorter than a window lose nothing. Rows that repeat a doc_id are one
    document and take nothing from each other; a null id ranks with the largest id there is, and rows without id
    take nothing from each other. Removal may cut a multi-byte character; kept is binary. An empty table gives an empty result;
    other columns are ignored.
    """
    count = partitions(docs.sparkSession)
    base = R.dealt(R.keyed(docs, id_col, text_col, carry))
    schema = T.StructType.fromDDL("doc_id long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary"))
    schema = T.StructType([*schema, *base.select(*(["carry"] if carry else [])).schema])
    salt, bits_ = 0, HASH_BITS if hash_bits is None else hash_bits
    while True:
        out = materialize(_removed(base, window, gram, count, schema, as_text, salt, bits_), "passages")
        if out.where("not borne_out").isEmpty():
            return out.drop("borne_out")
        salt, bits_ = salt + 1, 48


def _removed(base: DataFrame, window: int, gram: int, count: int, schema: T.StructType, as_text: bool, salt: int, hash_bits: int) -> DataFrame:
    """The result and borne_out: false in a block where a stretch does not stand that another block was told of."""

    def heard(block: R.Block, told: R.Told) -> Contexts:
        return Contexts(block, window, gram).hear(told, count)

    def ask_anchors(block: R.Block, told: R.Told) -> Iterator[tuple[int, R.Parts]]:
        return Contexts(block, window, gram).anchors.ask(count)

    def ask_hashes(block: R.Block, told: R.Told) -> Iterator[tuple[int, R.Parts]]:
        c = heard(block, told)
        h = c.hashes(salt, hash_bits)
        for owner, x in R.by_owner(c.names, count):
            yield owner, [R.steps(c.names[x] >> R.SHORT), six(h[x]), R.planes(c.least[x]), R.planes(c.start[c.lead[x]].astype(np.uint32))]

    def ask_contexts(block: R.Block, told: R.Told) -> Iterator[tuple[int, R.Parts]]:
        c, squeeze = heard(block, told).judged(told, count), zstd.ZstdCompressor(level=1).compress
        out: dict[int, R.Parts] = {}
        for owner, x in c.speakers(count):
            start, size = c.start[c.lead[x]], c.size[c.lead[x]]
            out[owner] = [squeeze(c.buf[R.flat(start, size)].tobytes()), R.planes(size.astype(np.uint32)), R.steps(c.names[x] >> R.SHORT), R.planes(c.least[x]), b"", b"", b"", b""]
        to, there, here, size = c.claims()
        for owner in np.unique(to % count).tolist():
            x = np.flatnonzero(to % count == owner)
            parts = out.setdefault(owner, [squeeze(b""), b"", b"", b"", b"", b"", b"", b""])
            parts[4:] = [R.planes(to[x].astype(np.int32)), R.planes(there[x].astype(np.uint32)), R.planes(size[x].astype(np.uint32)), squeeze(c.buf[R.flat(here[x], size[x])].tobytes())]
        yield from out.items()

    def cut(block: R.Block, told: R.Told) -> pa.Table:
        c = heard(block, told).judged(told, count)
        whole = c.whole
        ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        for owner, x in c.speakers(count):
            parts = told[RANGES, owner]
            whole[x] |= R.unbits(parts[0], len(x))
            of, off, ln = (R.unplanes(p, np.uint32).astype(np.int64) for p in parts[1:])
            ranges.append((x[of], off, ln))
        of, off, ln = (np.concatenate(r) for r in zip(*ranges))
        over = whole[c.cls] | (c.ids > c.least[c.cls])
        # ranges go to all of the class that do not lose it whole
        rest = np.flatnonzero(~over)
        rest = rest[np.argsort(c.cls[rest], kind="stable")]
        a, b = np.searchsorted(c.cls[rest], of), np.searchsorted(c.cls[rest], of, side="right")
        start = np.concatenate([c.start[over], c.start[rest[R.flat(a, b - a)]] + np.repeat(off, b - a)])
        gone = R.union(start, np.concatenate([c.size[over], np.repeat(ln, b - a)]), len(c.buf))
        true = borne_out(c.buf, [p for (kind, _), p in told.items() if kind == CLAIMS])
        rows, at = [], 0
        for d, null, h, t in zip(block.ids.tolist(), block.null.tolist(), block.hs.tolist(), block.texts):
            g = gone[at : at + len(t)]
            kept = c.buf[at : at + len(t)][~g].tobytes() if g.any() else t
            n_spans = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1))
            rows.append((None if null else d, h, len(t), int(g.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept))
            at += len(t)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string() if as_text else pa.binary()]
        cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] + block.rest.columns + [pa.array([true] * len(rows), pa.bool_())]
        return pa.Table.from_arrays(cols, names=[*(f.name for f in schema), "borne_out"])

    hot = R.HOT_BLOCKS, R.HOT_ITEMS
    shared = R.converse(base, None, ask_anchors, lambda blocks, asked: R.own_keys(blocks, asked, SHARED, *hot))
    judged = shared.unionByName(R.converse(base, shared, ask_hashes, own_hashes))
    repeated = R.converse(base, judged, ask_contexts, lambda blocks, asked: own_contexts(blocks, asked, window))
    return R.finish(base, judged.unionByName(repeated), cut, T.StructType([*schema, T.StructField("borne_out", T.BooleanType())]))
