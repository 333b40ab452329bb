"""Byte-level BPE by corpus-level merge replay.

Blocks of documents send their distinct chunks, words with the blank before them, to owners, so every chunk of the
corpus is encoded once. An owner lays the distinct pieces of its chunks out as one symbol array and keeps an
inverted index from mergeable token pair to the places where it stands. The lowest rank in the index is
replayed at all its places at once; only the neighbours of a merged pair enter the index anew. Blocks then
put documents together from what owners say of their chunks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from termwright.llm import messages as M, tokens as T

IDS = 2
#: Distinct pieces replayed together.
REPLAYED = 1 << 18
#: White space that is more than one blank between two words.
ODD_SPACE = regex.compile(r"(\s*[^\S ]\s*|  +)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class MergeReplay:
    """Encodes batches of distinct pieces with one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(rank)
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank each pair merges into, -1 if none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def scalar(self, piece: bytes) -> list[int]:
        """The leftmost lowest pair first, one at a time: for pieces whose merges don't come in rank order."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(p)) is not None else None for p in pieces]
        open_ = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
        for i, ids in enumerate(out):
            if ids is None and not pieces[i]:
                out[i] = []
        if open_:
            for i, ids in zip(open_, self._replay([pieces[i] for i in open_])):
                out[i] = ids
        return out

    def _replay(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.array([len(p) for p in pieces])
        word = np.repeat(np.arange(len(pieces)), size)
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        right[ends - 1] = -1
        left[ends - size] = -1
        odd = np.zeros(len(pieces), bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(ranks: np.ndarray, at: np.ndarray) -> None:
            live = ranks >= 0
            ranks, at = ranks[live], at[live]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, places in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(right >= 0)
        post(self.merged(sym[start], sym[right[start]]), start)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            at = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            at = at[sym[at] >= 0]
            at = at[right[at] >= 0]
            at = at[self.merged(sym[at], sym[right[at]]) == rank]
            if not len(at):
                continue
            # of places that overlap (a a a), the left one merges: within a chain of touching places, every second
            touch = np.concatenate([[False], right[at[:-1]] == at[1:]])
            if touch.any():
                head = np.flatnonzero(~touch)
                depth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at = at[depth % 2 == 0]
            twice = word[at]
            twice = twice[1:][twice[1:] == twice[:-1]]
            gone = right[at]
            after, before = right[gone], left[at]
            sym[at] = rank
            sym[gone] = -1
            right[at] = after
            left[after[after >= 0]] = at[after >= 0]
            a = at[after >= 0]
            b = before[before >= 0]
            for places in (a, b):
                ranks = self.merged(sym[places], sym[right[places]])
                # a lower rank that arises while the word had two places: the order within the word matters
                if len(twice) and ((ranks >= 0) & (ranks <= rank)).any():
                    odd[np.intersect1d(word[places[(ranks >= 0) & (ranks <= rank)]], twice)] = True
                post(ranks, places)
        keep = sym >= 0
        ids = np.split(sym[keep], np.cumsum(np.bincount(word[keep], minlength=len(pieces)))[:-1])
        return [self.scalar(p) if o else x.tolist() for p, o, x in zip(pieces, odd.tolist(), ids)]


@lru_cache(2)
def vocabulary(path: str) -> tuple[MergeReplay, dict[int, bytes]]:
    """One for each worker process."""
    ranks = load_ranks(path)
    return MergeReplay(ranks), {r: t for t, r in ranks.items()}


def chunks(text: bytes) -> list[str]:
    """Words with the blank before them, and white space the way the split pattern leaves it; no piece crosses these.

    Of white space before a word the pattern keeps the last character apart, and only a blank joins the word.
    """
    out: list[str] = []
    white = None
    for k, part in enumerate(ODD_SPACE.split(text.decode("utf-8", "surrogatepass"))):
        if k % 2:
            white = part
            continue
        if not part:
            continue
        # words with single blanks between them; one before the first is no odd white space
        words = part.split(" ")
        first, rest = words[0], words[1:]
        if white is not None:
            if white[:-1]:
                out.append(white[:-1])
            if white[-1] == " ":
                first = " " + first
            else:
                out.append(white[-1])
            white = None
        if first:
            out.append(first)
        out += [" " + w for w in rest]
    if white is not None:
        out.append(white)
    return out


def encode_chunks(checks: list[int], asked: list[M.Parts], path: str, pattern: str) -> list[tuple[int, int, M.Parts]]:
    """The ids of every chunk: the distinct pieces of all that were asked for are replayed together."""
    split, (replay, _) = regex.compile(pattern), vocabulary(path)
    index, of = T.Numbered(), []
    for p in asked:
        words = T.read_words(p)
        of.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    pieces = T.Numbered()
    parts = [[pieces[x.encode("utf-8", "surrogatepass")] for x in split.findall(w.decode("utf-8", "surrogatepass"))] for w in index]
    listed, ids = list(pieces), []
    for at in range(0, len(listed), REPLAYED):
        ids += replay.encode(listed[at : at + REPLAYED])
    whole = [ids[x[0]] if len(x) == 1 else [i for p in x for i in ids[p]] for x in parts]
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    flat, start = np.fromiter((i for x in whole for i in x), np.uint32, int(size.sum())), np.cumsum(size) - size
    return [(c, 0, [p[0], M.pack(size[x].astype(np.uint32)), M.pack(flat[M.flat(start[x], size[x])])]) for c, p, x in zip(checks, asked, of)]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves.

    A null text counts as empty and has no tokens. Texts are encoded whole; decoding gives their exact UTF-8
    bytes back. Repeated rows repeat; an empty table gives an empty result; other columns are ignored. The
    vocabulary file must be readable on every executor. Texts are cut into blocks twice, rather than written down:
    docs must give its rows in the same order again, as files do. A block that is not the one that asked fails.
    """
    owners = M.owners_for(T.text_bytes(docs, text_col), docs.sparkSession)
    cut = T.cut(docs, owners, lambda b, n: np.zeros(n, np.uint8), id_col, text_col, split=chunks, block_bytes=block_bytes)
    ids = M.settle(cut.where(F.col("kind") == T.WORDS), owners, IDS, lambda o, _, asked: encode_chunks([int.from_bytes(p[4], "little") for p in asked], asked, path, pattern))

    def end(block: int, mail: M.Mail) -> pa.Table:
        b, (_, bytes_of) = T.Block(mail.one(T.BASE)), vocabulary(path)
        shown, decoded, known = [""] * b.distinct, [b""] * b.distinct, [[]] * b.distinct
        size = np.zeros(b.distinct, np.int64)
        if any(r[3] != b.check() for r in mail[IDS]):
            raise ValueError(f"block {block} is not the one that asked: docs came in another order")
        for r in mail[IDS]:
            x, n, flat = M.unpack_sorted(r[5][0], np.uint32), M.unpack(r[5][1], np.uint32), M.unpack(r[5][2], np.uint32).tolist()
            size[x] = n
            to = np.cumsum(n, dtype=np.int64).tolist()
            for i, lo, hi in zip(x.tolist(), [0, *to[:-1]], to):
                mine = flat[lo:hi]
                shown[i], decoded[i] = " ".join(map(str, mine)), b"".join(map(bytes_of.__getitem__, mine))
                if with_ids:
                    known[i] = mine
        rows, at = [], 0
        for d, null, n in zip(b.ids.tolist(), b.null.tolist(), b.sizes.tolist()):
            x = b.tokens[at : at + n]
            at += n
            doc = x.tolist()
            text = hashlib.sha256(" ".join(map(shown.__getitem__, doc)).encode()).hexdigest()
            back = hashlib.sha256(b"".join(map(decoded.__getitem__, doc))).hexdigest()
            rows.append((None if null else d, int(size[x].sum()), text, back, *([[i for c in doc for i in known[c]]] if with_ids else [])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + with_ids]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)), kinds)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return M.visit_with(cut.where(F.col("kind") == T.BASE), ids, end, schema)
