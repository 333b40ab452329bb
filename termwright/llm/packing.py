"""Best-fit packing through a configuration linear program.

Pieces matter to the program only by length, and there are at most `capacity` lengths, so the histogram is
all the driver sees whatever the corpus. Lengths are priced in classes: multiplicative weights price the
classes, a knapsack dynamic program finds the best configuration at those prices, and each configuration is
used for a share of the demand it covers, until the demand is covered. Counts are rounded along the running
sum of the fractional ones, and subset sums choose the lengths that a class stands for, so that a sequence comes
out full. What rounding leaves uncovered goes through the same program again. Spark then deals the pieces of
each length, by rank, to the slots that the configurations hold for it.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from termwright.llm import messages as M, tokens as T
from termwright.llm.runtime import materialize

IDS = 2
#: Lengths priced as one at most: the program has so many rows.
CLASSES = 64
#: Rows of the slot table that are broadcast at most (about 60 bytes each).
BROADCAST_ROWS = 400_000
#: Words encoded at once: an encoding is far larger than its ids.
LOT = 4096
#: Words encoded as one text, and what stands between them.
JOINED, BETWEEN = 64, "0"


def encoded(tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of words, each encoded as if alone.

    Most of an encoding's time goes to starting it. Where the tokenizer makes a token of its own of a BETWEEN among
    spaces, words without it are encoded many at a time with it between them; other words one by one.
    """
    probe = f"a {BETWEEN} b"
    apart = (tok.normalizer is None or tok.normalizer.normalize_str(probe) == probe) and tok.pre_tokenizer is not None and [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(probe)] == probe.split()
    mark = tok.encode(BETWEEN, add_special_tokens=False).ids
    plain = [i for i, w in enumerate(words) if BETWEEN not in w] if apart and len(mark) == 1 else []
    sizes, order, parts = np.zeros(len(words), np.int64), [], [np.zeros(0, np.uint32)]
    lots = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
    alone = np.ones(len(words), bool)
    for at in range(0, len(lots), LOT // JOINED):
        some = lots[at : at + LOT // JOINED]
        texts = [f" {BETWEEN} ".join([words[i] for i in lot]) for lot in some]
        for lot, e in zip(some, tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == mark[0])
            if len(marks) == len(lot) - 1:
                sizes[lot] = np.diff(marks, prepend=-1, append=len(ids)) - 1
                alone[lot] = False
                order += lot
                parts.append(np.delete(ids, marks))
    rest = np.flatnonzero(alone).tolist()
    for at in range(0, len(rest), LOT):
        some = rest[at : at + LOT]
        for i, e in zip(some, tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
            sizes[i] = len(e.ids)
            parts.append(np.array(e.ids, np.uint32))
    order = np.array(order + rest, np.int64)
    start = np.empty(len(words), np.int64)
    start[order] = np.cumsum(sizes[order]) - sizes[order]
    return sizes, np.concatenate(parts)[M.flat(start, sizes)]


def encode_words(asked: list[M.Parts], tokenizer_path: str) -> list[tuple[int, int, M.Parts]]:
    """The ids of every word, each distinct word encoded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    index, of = T.Numbered(), []
    for p in asked:
        words = T.read_words(p)
        of.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    size, ids = encoded(tok, [w.decode("utf-8", "replace") for w in index])
    start = np.cumsum(size) - size
    return [(0, 0, [p[0], M.pack(size[x].astype(np.uint16)), M.pack(ids[M.flat(start[x], size[x])])]) for p, x in zip(asked, of)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the block that made it), and with_ids the token ids.

    White space never enters a token of a word-level tokenizer, so a text's ids are those of its words.
    """
    owners = M.owners_for(T.text_bytes(docs, text_col), docs.sparkSession)
    cut = materialize(T.cut(docs, owners, lambda b, n: np.zeros(n, np.uint8), id_col, text_col, block_bytes=block_bytes), "words")
    ids = M.settle(cut.where(F.col("kind") == T.WORDS), owners, IDS, lambda o, _, asked: encode_words(asked, tokenizer_path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part"]

    def end(block: int, mail: M.Mail) -> pa.Table:
        b = T.Block(mail.one(T.BASE))
        size, start, lots, at = np.zeros(b.distinct, np.int64), np.zeros(b.distinct, np.int64), [np.zeros(0, np.uint32)], 0
        for r in mail[IDS]:
            x, n = M.unpack_sorted(r[5][0], np.uint32), M.unpack(r[5][1], np.uint16).astype(np.int64)
            size[x], start[x] = n, at + np.cumsum(n) - n
            lots.append(M.unpack(r[5][2], np.uint32))
            at += len(lots[-1])
        ids = np.concatenate(lots)
        rows, lo, last = [], 0, np.array([end_id], np.uint32)
        for d, null, n in zip(b.ids.tolist(), b.null.tolist(), b.sizes.tolist()):
            x = b.tokens[lo : lo + n]
            lo += n
            doc = np.concatenate([ids[M.flat(start[x], size[x])], last]).astype("<u4")
            for k, i in enumerate(range(0, len(doc), capacity)):
                part = doc[i : i + capacity]
                rows.append((None if null else d, k, i, len(part), zlib.crc32(part.tobytes()), block, *([part] if with_ids else [])))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 + with_ids]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)), kinds)], names=[*names, "ids"][: 6 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long" + ", ids array<int>" * with_ids
    return M.visit_with(cut.where(F.col("kind") == T.BASE), ids, end, schema)


@dataclass
class Classes:
    """The lengths still to place, in classes: neighbouring lengths of about the same number of tokens together."""

    lengths: list[list[int]]
    size: np.ndarray
    demand: np.ndarray

    @classmethod
    def of(cls, left: dict[int, int], most: int) -> Classes:
        keys = np.array(sorted(left))
        count = np.array([left[k] for k in keys.tolist()])
        mass = np.cumsum(keys * count)
        group = np.minimum(mass * most // (mass[-1] + 1), most - 1) if len(keys) > most else np.arange(len(keys))
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        demand = np.add.reduceat(count, heads)
        size = np.rint(np.add.reduceat(keys * count, heads) / demand).astype(np.int64)
        return cls([x.tolist() for x in np.split(keys, heads[1:])], size, demand.astype(float))


def price(size: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset that fits, of each class at most `most`: class -> how often. Of equal ones that with the larger sizes."""
    best = np.zeros(capacity + 1, np.float32)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in range(len(size) - 1, -1, -1):
        left, k = min(int(most[i]), capacity // int(size[i])), 1
        while left > 0:
            k = min(k, left)
            s = k * int(size[i])
            with_ = best[:-s] + np.float32(k * value[i])
            better = with_ > best[s:]
            np.maximum(best[s:], with_, out=best[s:])
            steps.append((i, k, better))
            left, k = left - k, 2 * k
    found, room = {}, capacity
    for i, k, better in reversed(steps):
        s = k * int(size[i])
        if room >= s and better[room - s]:
            found[i] = found.get(i, 0) + k
            room -= s
    return found


def fractional(classes: Classes, capacity: int, step: float = 0.15, sharp: float = 8.0, tolerance: float = 0.01) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used, by multiplicative weights, until all but `tolerance` of the tokens are covered.

    A class weighs less the more of it is covered, so what is hard to place is placed while there is still
    company for it.
    """
    size, demand = classes.size, classes.demand
    left, used = demand.copy(), []
    mass = float((demand * size).sum())
    while float((left * size).sum()) > tolerance * mass:
        weight = size * np.exp(sharp * left / demand)
        config = price(size, weight, np.ceil(left), capacity)
        at, often = np.fromiter(config, int), np.fromiter(config.values(), float)
        # a share of the demand that is left, or what uses a class up when little is
        x = float((left[at] / often).min())
        x = min(x, max(1.0, step * x))
        used.append((config, x))
        left[at] = np.maximum(left[at] - often * x, 0)
        left[left < 1e-9] = 0
    return used


def rounded(used: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """Whole numbers whose running sum is never more than one half from that of the fractional ones."""
    out, total, given = [], 0.0, 0
    for config, x in used:
        total += x
        n = int(np.floor(total + 0.5)) - given
        given += n
        if n:
            out.append((config, n))
    return out


def lengths_for(config: dict[int, int], classes: Classes, left: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths for a configuration's classes whose sum comes closest to the capacity, of those still left: length -> how often."""
    slots = [i for i, n in sorted(config.items(), reverse=True) for _ in range(n)]
    mask, reach, trail = (1 << capacity + 1) - 1, 1, []
    room: dict[int, int] = {}
    for i in slots:
        have = sum(left.get(k, 0) for k in classes.lengths[i])
        if room.get(i, 0) >= have:
            continue
        room[i] = room.get(i, 0) + 1
        keys, new = [k for k in classes.lengths[i] if left.get(k, 0)], 0
        for k in keys:
            new |= reach << k
        new &= mask
        if not new:
            continue
        trail.append((keys, reach))
        reach = new
    found: dict[int, int] = {}
    at = reach.bit_length() - 1
    for keys, before in reversed(trail):
        fits = [k for k in keys if at >= k and before >> at - k & 1]
        free = [k for k in fits if found.get(k, 0) < left[k]]
        if free:
            k = max(free, key=lambda k: left[k] - found.get(k, 0))
            found[k] = found.get(k, 0) + 1
            at -= k
        elif fits:
            at -= fits[0]
    # a length that ran out leaves room: the largest that fit go there
    room_left = capacity - sum(k * n for k, n in found.items())
    for k in sorted((k for k, n in left.items() if k <= room_left and n > found.get(k, 0)), reverse=True) if room_left else []:
        if n := min(left[k] - found.get(k, 0), room_left // k):
            found[k] = found.get(k, 0) + n
            room_left -= n * k
    return found


def solve(histogram: dict[int, int], capacity: int = 4096, most: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> how often) and the number of sequences of each; every piece is placed once, by the program.

    A sequence that comes out less full than `floor` waits for the program over what is left; where a program
    places less than a third of it, the floor gives way.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    out, floor = [], capacity
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    while left:
        classes, placed, mass = Classes.of(left, most), 0, sum(k * n for k, n in left.items())
        for config, n in rounded(fractional(classes, capacity)) or [({len(classes.size) - 1: 1}, 1)]:
            while n:
                found = lengths_for(config, classes, left, capacity)
                if not found or sum(k * c for k, c in found.items()) < floor:
                    break
                times = min(-(-n // 4), *(left[k] // c for k, c in found.items()))
                out.append((found, times))
                placed, n = placed + times * sum(k * c for k, c in found.items()), n - times
                for k, c in found.items():
                    left[k] -= c * times
                    if not left[k]:
                        del left[k]
        if placed < mass / 3:
            floor = max(0, floor - max(1, capacity - floor))
    return out


def slots(solution: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, end rank, pieces a sequence, first sequence, first offset: where a length's pieces go, by rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in solution:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            first = rank.get(length, 0)
            rows.append((length, first, first + n * times, n, sequence, offset))
            rank[length] = first + n * times
            offset += n * length
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = 4096, most: int = CLASSES) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that has doc_id, piece, length and part.

    The slot table is what the driver makes of a histogram of at most `capacity` lengths; it is broadcast if
    it has no more than BROADCAST_ROWS rows, and joined by length otherwise.
    """
    spark = cut.sparkSession
    counts = materialize(cut.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = slots(solve(histogram, capacity, most))
    table = spark.createDataFrame(rows, "slot_length long, first long, upto long, each long, sequence long, place long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("ahead"))
    placed = ranked.join(F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto")))
    at = F.col("rank") - F.col("first")
    return placed.withColumns(
        {"sequence_id": F.col("sequence") + F.floor(at / F.col("each")).cast("long"), "offset": F.col("place") + at % F.col("each") * F.col("length")}
    ).drop("slot_length", "first", "upto", "each", "sequence", "place", "nth", "ahead", "rank", "part")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids).

    A null text counts as empty and is one piece, the end id alone. Documents longer than a sequence are cut
    into full pieces and a rest. Repeated rows are packed each; an empty table gives an empty result; other
    columns are ignored. The tokenizer file must be readable on every executor.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
