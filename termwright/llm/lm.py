"""Trigram language-model scores through sharded Elias-Fano tries.

Blocks of documents ask the owners of their distinct words for names and training counts, and then the owners
of their distinct word pairs (v, w) for the probabilities of pairs and of the words u before them. Questions
carry the block's own training counts, so they are the training data as well, each block's counted once. An
owner builds a trie v - w - u of all it was asked about that training has, with quantised smoothed joint
probabilities, and answers every block from it. A word's pairs are spread over owners by its count, and a
frequent pair's words u over further ones, so no owner's share grows with how often a word is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from termwright.llm import messages as M, tokens as T
from termwright.llm.elias_fano import Trie
from termwright.llm.messages import U64, mix
from termwright.llm.runtime import crc_mod, materialize

COUNTS, ASKED, FOUND = 2, 3, 4
START, END = U64(1), U64(2)
FIRST_NAME = 3
#: log10 steps of a quantised probability; MISSING marks what training never saw.
STEP, MISSING = 4096, 0xFFFF
OWNER_BYTES = 8 << 20


def count_words(owner: int, asked: list[M.Parts], owners: int) -> list[tuple[int, int, M.Parts]]:
    """Names (frequent words first) and training counts of the words, by comparing the words; a and b are the owner's trained tokens and types."""
    index, of, said = T.Numbered(), [], []
    for p in asked:
        words = T.read_words(p)
        of.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        said.append(M.unpack(p[1], np.uint32))
    c = np.bincount(np.concatenate(of), np.concatenate(said), len(index)).astype(np.int64)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    names = (rank * owners + owner + FIRST_NAME).astype(U64)
    return [(int(c.sum()), int((c > 0).sum()), [p[0], M.pack(names[x]), M.pack(c[x])]) for p, x in zip(asked, of)]


class Totals:
    """Of all training documents: tokens with ends, distinct tokens, documents, and owners of pairs."""

    def __init__(self, tokens: int, types: int, docs: int, owners: int):
        self.n, self.v, self.docs, self.owners = tokens + docs, types + (docs > 0), docs, owners


class Grams:
    """A block's tokens with names and counts, and its distinct pairs and triples."""

    def __init__(self, mail: M.Mail, totals: Totals):
        b = self.block = T.Block(mail.one(T.BASE))
        self.totals, k = totals, b.distinct
        # numbers: the block's words, then the end, then the start
        self.name, self.count = np.empty(k + 2, U64), np.empty(k + 2, np.int64)
        self.name[k:], self.count[k:] = (END, START), totals.docs
        for r in mail[COUNTS]:
            at = M.unpack_sorted(r[5][0], np.uint32)
            self.name[at], self.count[at] = M.unpack(r[5][1], U64), M.unpack(r[5][2], np.int64)
        n = b.sizes + 1
        self.n, self.doc = n, np.repeat(np.arange(len(n), dtype=np.int32), n)
        last = np.cumsum(n) - 1
        self.w = np.full(len(self.doc), k, np.uint32)
        inner = np.ones(len(self.doc), bool)
        inner[last] = False
        self.w[inner] = b.tokens
        first = last - b.sizes
        self.v = np.concatenate([np.zeros(1, np.uint32), self.w[:-1]])
        self.v[first] = k + 1
        u = np.concatenate([np.zeros(1, np.uint32), self.v[:-1]])
        u[first] = k + 1
        # distinct triples by v, w, u
        wide = (k + 1).bit_length()
        if 3 * wide < 64:
            key = self.v.astype(U64) << U64(2 * wide) | self.w.astype(U64) << U64(wide) | u.astype(U64)
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
        else:
            order = np.lexsort((u, self.w, self.v))
            new = np.concatenate([[True], np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (u, self.w, self.v)])])
        head = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        at = order[head]
        self.tv, self.tw, self.tu = self.v[at], self.w[at], u[at]
        trained = ~b.mark[self.doc]
        self.seen = np.bincount(self.of, trained, len(head)).astype(np.uint32)
        new = np.concatenate([[True], (self.tv[1:] != self.tv[:-1]) | (self.tw[1:] != self.tw[:-1])])
        self.pair_head = np.flatnonzero(new)
        self.pair = np.cumsum(new, dtype=np.int32) - 1
        self.pv, self.pw = self.tv[self.pair_head], self.tw[self.pair_head]
        self.pair_seen = np.add.reduceat(self.seen, self.pair_head)
        self.deal()

    def deal(self) -> None:
        """Owners of pairs, and of triples: those of their pair, or further ones for the u of pairs whose words are both frequent."""
        count, name, t = self.count, self.name, self.totals
        owners, n = t.owners, max(1, t.n)
        parts = np.minimum(-(-4 * count * owners // n), owners).clip(1).astype(U64)
        h = mix(name)
        self.pair_owner = (mix(h[self.pv] + h[self.pw] % parts[self.pv]) % U64(owners)).astype(np.int32)
        both = np.minimum(count[self.pv], count[self.pw])
        spread = np.minimum(both * owners // n, owners)
        self.owner = self.pair_owner[self.pair]
        far = np.flatnonzero(spread[self.pair] > 1)
        p = self.pair[far]
        shift = (h[self.tu[far]] % spread[p].astype(U64)).astype(np.int64)
        self.owner[far] = (self.pair_owner[p] + shift) % owners
        # rows asked: a pair and its triples of one owner, in the order of owner, pair; a pair's own owner hears of it in any case
        order = np.argsort(self.owner.astype(np.uint16 if owners < 1 << 16 else np.int32), kind="stable")
        o, p = self.owner[order], self.pair[order]
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])])
        head = np.flatnonzero(new)
        lone = np.setdiff1d(self.pair[far], p[head][o[head] == self.pair_owner[p[head]]])
        self.order = order
        ro, rp = np.append(o[head], self.pair_owner[lone]), np.append(p[head], lone)
        size = np.append(np.diff(np.append(head, len(order))), np.zeros(len(lone), np.int64))
        start = np.append(head, np.zeros(len(lone), np.int64))
        line = np.argsort(ro, kind="stable")
        self.row_owner, self.row_pair, self.row_size, self.row_start = ro[line], rp[line], size[line], start[line]

    def mail(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each owner, its rows and their triples."""
        heads = np.flatnonzero(np.diff(self.row_owner, prepend=-1))
        for i, j in zip(heads.tolist(), np.append(heads[1:], len(self.row_owner)).tolist()):
            yield int(self.row_owner[i]), np.arange(i, j), self.order[M.flat(self.row_start[i:j], self.row_size[i:j])]

    def ask(self, block: int) -> list[M.Row]:
        out = []
        for o, rows, triples in self.mail():
            p = self.row_pair[rows]
            own = self.pair_owner[p] == o
            out.append((o, ASKED, block, 0, 0, [M.pack(self.name[self.pv[p]]), M.pack(self.name[self.pw[p]]), M.pack(np.where(own, self.pair_seen[p], 0).astype(np.uint32)), M.pack(self.row_size[rows].astype(np.uint32)), M.pack(self.name[self.tu[triples]]), M.pack(self.seen[triples])]))
        return out

    def scores(self, found: list[M.Row], prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: known tokens, base score and score."""
        t, parts = self.totals, {r[2]: r[5] for r in found}
        c2, c3 = np.zeros(len(self.pv)), np.zeros(len(self.tv))
        for o, rows, triples in self.mail():
            p = self.row_pair[rows]
            own = self.pair_owner[p] == o
            c2[p[own]] = joint_count(M.unpack(parts[o][0], np.uint16)[own], t.n)
            c3[triples] = joint_count(M.unpack(parts[o][1], np.uint16), t.n)
        p1 = (self.count + 1) / (t.n + t.v + 1)
        p2 = (c2 + prior * p1[self.pw]) / (self.count[self.pv] + prior)
        # the pair (u, v) of a triple; a text's first token has none, and its context was seen once a document
        context = np.full(len(self.tv), float(t.docs))
        inner = np.flatnonzero(self.tv < len(self.name) - 1)
        wide = np.int64(len(self.name))
        context[inner] = c2[np.searchsorted(self.pv * wide + self.pw, self.tu[inner] * wide + self.tv[inner])]
        p3 = np.minimum((c3 + prior * p2[self.pair]) / (context + prior), 1.0)
        docs = len(self.n)
        return (np.bincount(self.doc, self.count[self.w] > 0, docs).astype(np.int64), np.bincount(self.doc, np.log10(p1)[self.w], docs), np.bincount(self.doc, np.log10(p3)[self.of], docs))


def joint_count(q: np.ndarray, n: int) -> np.ndarray:
    return np.where(q == MISSING, 0.0, n * 10.0 ** (-q.astype(np.float64) / STEP))


def quantised(c: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(c / max(1, n)) * STEP), MISSING - 1).astype(np.uint16)


def own_pairs(asked: list[M.Parts], n: int) -> list[tuple[int, int, M.Parts]]:
    """A trie of all pairs and triples that training has, and what it says to each block."""
    v, w, u = (np.concatenate([M.unpack(p[i], U64) for p in asked]) for i in (0, 1, 4))
    pc, size, tc = (np.concatenate([M.unpack(p[i], np.uint32) for p in asked]) for i in (2, 3, 5))
    sizes, triples = [len(M.unpack(p[3], np.uint32)) for p in asked], [len(M.unpack(p[5], np.uint32)) for p in asked]
    size = size.astype(np.int64)
    order = np.lexsort((w, v))
    new = np.concatenate([[True], (v[order[1:]] != v[order[:-1]]) | (w[order[1:]] != w[order[:-1]])])
    pair = np.empty(len(v), np.int64)
    pair[order] = np.cumsum(new) - 1
    at = order[new]
    v, w = v[at], w[at]
    c2 = np.bincount(pair, pc, len(v))
    triple = np.repeat(pair, size)
    line = np.lexsort((u, triple))
    new = np.concatenate([[True], (triple[line[1:]] != triple[line[:-1]]) | (u[line[1:]] != u[line[:-1]])]) if len(line) else np.zeros(0, bool)
    of = np.empty(len(u), np.int64)
    of[line] = np.cumsum(new) - 1
    at = line[new]
    u, t_pair = u[at], triple[at]
    c3 = np.bincount(of, tc, len(u))
    del line, order, triple
    # a pair whose own count is elsewhere is in the trie for its triples
    has = np.bincount(t_pair, c3 > 0, len(v)) > 0
    k2, k3 = (c2 > 0) | has, c3 > 0
    number = np.cumsum(k2) - 1
    value = np.full(len(v), MISSING, np.uint16)
    value[c2 > 0] = quantised(c2[c2 > 0], n)
    trie = Trie(v[k2], w[k2], value[k2], number[t_pair[k3]], u[k3], quantised(c3[k3], n))
    place = trie.find_pairs(v, w)
    q2 = trie.pairs.value(place, MISSING)
    q3 = trie.triples.value(trie.find_triples(place[t_pair], u), MISSING)
    out, i, j = [], 0, 0
    for a, b in zip(sizes, triples):
        out.append((0, 0, [M.pack(q2[pair[i : i + a]]), M.pack(q3[of[j : j + b]])]))
        i, j = i + a, j + b
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (7, 2), prior: float = 4.0, block_bytes: int = M.BLOCK_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is log10 of the text's probability under
    P(w | u v) = (c(u v w) + prior * P(w | v)) / (c(u v) + prior), P(w | v) = (c(v w) + prior * P(w)) / (c(v) + prior),
    where P(w) is the base model's add-one estimate. A null or empty text is its end token alone. Rows with
    a null doc_id are never held out. Repeated rows count and score each. Without training rows N is 0. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col(id_col).cast("long"), fold[0]) == fold[1], F.lit(False))
    size, trained = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1), F.lit(0)), F.coalesce(F.sum((~held).cast("long")), F.lit(0))).first()
    owners = M.owners_for(size, spark, owner_bytes)

    def tell(b: T.Block, n: int) -> np.ndarray:
        return np.bincount(b.tokens, ~b.mark[b.doc], n).astype(np.uint32)

    cut = materialize(T.cut(docs, owners, tell, id_col, text_col, held, T.lower_words, block_bytes), "tokens")
    base = cut.where(F.col("kind") == T.BASE)
    counts = materialize(M.settle(cut.where(F.col("kind") == T.WORDS), owners, COUNTS, lambda o, _, asked: count_words(o, asked, owners)), "counts")
    said = counts.groupBy("source").agg(F.first("a").alias("a"), F.first("b").alias("b")).agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    totals = Totals(said[0], said[1], trained, owners)

    def ask(block: int, mail: M.Mail) -> pa.Table:
        return M.table(Grams(mail, totals).ask(block))

    def end(block: int, mail: M.Mail) -> pa.Table:
        g = Grams(mail, totals)
        known, low, score = g.scores(mail[FOUND], prior)
        ids = pa.array(g.block.ids, pa.int64(), mask=g.block.null)
        cols = [ids, g.block.mark, g.n, known, np.full(len(ids), totals.n), low, score]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = M.settle(M.visit_with(base, counts, ask), owners, FOUND, lambda o, _, asked: own_pairs(asked, totals.n))
    return M.visit_with(base, counts.unionByName(found), end, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
