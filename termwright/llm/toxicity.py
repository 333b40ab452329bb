"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed to buckets) and of itself; a document is
the mean of its words; a linear softmax over two classes sits on top. Vectors and softmax are trained
together by full-batch Adam on a bounded, documented sample of labelled rows. A misspelling that was never
seen shares most n-grams, and so most of its vector, with the word it disguises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from termwright.llm.runtime import crc_mod, id_text, slices

BUCKETS = 1 << 18
GRAMS = (4, 5, 6)
#: Labelled rows a fit reads at most, for each class.
TRAIN_PER_CLASS = 1500
#: Bytes of their texts, for each class.
TRAIN_BYTES = 24 << 20
REMEMBERED = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of <word> (bytes) and of the whole word, and the word each belongs to."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(buf))
    found, of = [], []

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)

    h = np.zeros(len(buf), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        h = h[: len(buf) - k + 1] * BASE + buf[k - 1 :]
        if k in GRAMS:
            at = np.flatnonzero(room[: len(h)] >= k)
            found.append(mix(h[at] + np.uint64(k)))
            of.append(owner[at])
    # the whole word: a position-weighted sum of its bytes
    place = np.arange(len(buf)) - np.repeat(ends - size, size)
    weight = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    term = (buf * BASE ^ weight) * (weight | np.uint64(1))
    found.append(mix(np.add.reduceat(term, ends - size)))
    of.append(np.arange(len(words)))
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Model:
    """What scoring needs: each bucket's vector times the softmax direction, and the bias."""

    weight: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        bucket, of = subwords(words)
        return np.bincount(of, self.weight[bucket], len(words)) / np.bincount(of, minlength=len(words))

    def probability(self, mean: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40))))


def fit(texts: list[str | None], labels: list[int], dim: int = 4, epochs: int = 60, rate: float = 0.05, seed: int = 7, least_docs: int = 5, least_z: float = 4.5, decay: float = 1e-4, scale: float = 100.0) -> Model:
    """Joint training; without rows of both classes the model says the share of toxic rows."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    docs = [np.unique(tokens(t), return_counts=True) if tokens(t) else (np.array([], "S1"), np.array([], int)) for t in texts]
    vocab = sorted({w for ws, _ in docs for w in ws.tolist()})
    number = {w: i for i, w in enumerate(vocab)}
    d_word = np.array([number[w] for ws, _ in docs for w in ws.tolist()], np.int32)
    d_of = np.repeat(np.arange(len(docs)), [len(ws) for ws, _ in docs])
    total = np.maximum(1, np.array([c.sum() for _, c in docs]))
    d_weight = np.concatenate([c for _, c in docs]).astype(np.float32) / total[d_of].astype(np.float32)
    bucket, of = subwords(vocab)
    every = np.bincount(of, minlength=len(vocab)).astype(np.float32)
    # n-grams that toxic rows do not have clearly more or less often than others carry no vector
    heads_of = np.searchsorted(np.sort(of), np.arange(len(vocab) + 1))
    grams = bucket[np.argsort(of, kind="stable")]
    have = np.zeros((2, BUCKETS), np.int32)
    for i, start in enumerate(d_starts := np.searchsorted(d_of, np.arange(len(docs)))):
        ws = d_word[start : d_starts[i + 1] if i + 1 < len(docs) else len(d_word)]
        spans = [grams[heads_of[w] : heads_of[w + 1]] for w in ws.tolist()]
        if spans:
            have[int(y[i]), np.unique(np.concatenate(spans))] += 1
    n, share_toxic = have.sum(0), y.mean()
    z = np.abs(have[1] - n * share_toxic) / np.sqrt(np.maximum(n, 1) * share_toxic * (1 - share_toxic))
    keep = ((z > least_z) & (n >= least_docs))[bucket]
    if not keep.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    used, slot = np.unique(bucket[keep], return_inverse=True)
    order = np.argsort(slot, kind="stable")
    w_of, w_slot = of[keep][order], slot[order]
    heads = np.flatnonzero(np.diff(w_slot, prepend=-1))
    share = (1 / every[w_of]).astype(np.float32)
    by_word = np.argsort(w_of, kind="stable")
    wh = np.flatnonzero(np.diff(w_of[by_word], prepend=-1))
    words_with = w_of[by_word][wh]
    d_by_word = np.argsort(d_word, kind="stable")
    dwh = np.flatnonzero(np.diff(d_word[d_by_word], prepend=-1))
    d_heads = np.flatnonzero(np.diff(d_of, prepend=-1))
    docs_with = d_of[d_heads]
    rng = np.random.default_rng(seed)
    emb = (rng.normal(size=(len(used), dim)) * 0.01).astype(np.float32)
    soft = (rng.normal(size=(2, dim)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    target = np.stack([1 - y, y], 1).astype(np.float32)
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)[:, None] / len(y)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, soft, bias)]
    scale = np.float32(scale)  # one toxic word in a hundred is a strong signal
    for step in range(1, epochs + 1):
        vec = np.zeros((len(vocab), dim), np.float32)
        vec[words_with] = np.add.reduceat((emb[w_slot] * share[:, None])[by_word], wh)
        doc = np.zeros((len(docs), dim), np.float32)
        doc[docs_with] = np.add.reduceat(vec[d_word] * d_weight[:, None], d_heads) * scale
        logit = doc @ soft.T + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * weigh
        g_soft, g_bias, g_doc = g.T @ doc + 1e-4 * soft, g.sum(0), (g @ soft) * scale
        g_vec = np.zeros((len(vocab), dim), np.float32)
        g_vec[d_word[d_by_word][dwh]] = np.add.reduceat((g_doc[d_of] * d_weight[:, None])[d_by_word], dwh)
        g_emb = np.add.reduceat(g_vec[w_of] * share[:, None], heads) + decay * emb
        for p_, g_, (m, v) in zip((emb, soft, bias), (g_emb, g_soft, g_bias), state):
            m += 0.1 * (g_ - m)
            v += 0.02 * (g_ * g_ - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = (emb @ (soft[1] - soft[0])) * scale
    return Model(weight, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, fold: tuple[int, int] = (3, 1), class_bytes: int = TRAIN_BYTES) -> tuple[list, list]:
    """Whole texts and labels of rows whose crc32(doc_id) leaves the fold out: of each class at most per_class rows and about class_bytes bytes.

    An id with both labels is left out; an id that labels repeat counts once. The driver sees the sizes of at most
    2 * per_class rows, and then the texts of those that fit.
    """
    m, held = fold
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((crc_mod(F.col("doc_id"), m) != held) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    rows = id_text(docs).withColumn("h", F.xxhash64("text"))
    # a document's row is told by its id and the hash of its text
    sized = rows.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(known, "doc_id")
    ids, left = {}, [class_bytes, class_bytes]
    for c in (0, 1):
        for r in sized.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(per_class).collect():
            if r.n <= left[c] and (r.doc_id, r.h) not in ids:
                ids[r.doc_id, r.h], left[c] = c, left[c] - r.n
    chosen = docs.sparkSession.createDataFrame([(d, h, c) for (d, h), c in ids.items()], "doc_id long, h long, toxic int")
    found = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text")).collect()
    found.sort(key=lambda r: (r.doc_id, r.h))
    return [r.text for r in found], [r.toxic for r in found]


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Whole texts are scored, and from the text alone. A null or empty text has no words and gets the score of
    the bias. Repeated rows repeat; an empty table gives an empty result; other columns are ignored. The
    model has a fixed size (2^18 buckets), so sending it to every task is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for ids, texts in slices(batches):
            bags = [tokens(t) for t in texts]
            new = list(set().union(*bags) - known.keys())
            if len(known) > REMEMBERED:
                known, new = {}, list(set().union(*bags))
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                known.update(zip(part, m.word_scores(part).tolist()))
            out = [m.probability(sum(map(known.__getitem__, ws)) / len(ws) if ws else 0.0) for ws in bags]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), fold[0]) == fold[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """Fits on labels (doc_id, toxic 0 or 1) and scores every row of docs: doc_id, held_out, score, predicted.

    Other columns of both tables are ignored. Labels that are null or neither 0 nor 1, and ids that are labelled both
    ways, teach nothing; without labels of both classes all rows get one score. Nulls, repeats and empty
    tables as in score().
    """
    return score(docs, fit(*training_rows(docs, labels, per_class)))
