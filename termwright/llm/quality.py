"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean Column over one document's text and words ("it fails") and computes what it needs by
itself. `plan_cascade` times each rule and counts what it rejects on a random sample, then orders the rules by
rejections per second. `cascade` folds them into one CASE, which Spark evaluates in that order and leaves at the
first rule that rejects, so what a later rule would compute is never computed for a document rejected before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from termwright.llm.runtime import SPACE, materialize

#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

#: Documents the planner looks at, about; the verdict does not depend on them.
SAMPLE_ROWS = 500
#: How often the sample is repeated for one timing, so that rules cost more than starting a job, and timings of a rule.
TIMES, ROUNDS = 4, 2

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")).cast("long")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the document has twice or more.

    Windows are hashed; only a document with a repeated hash sorts its windows to find which positions
    repeat, so ordinary documents never pay for the sort.
    """

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # each window beside the next one of the sorted list: equal neighbours repeat
        def places(r: Column) -> Column:
            equal = F.zip_with(r, F.slice(r, F.lit(2), F.size(r)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            either = let(equal, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))
            return F.sort_array(F.filter(F.zip_with(r, either, lambda a, b: F.when(b, a["i"])), lambda x: x.isNotNull()))

        def reach(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        return F.when(F.size(windows) > F.size(F.array_distinct(windows)), let(let(ranked, places), reach)).otherwise(F.lit(0))

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 7, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 8)))
    return F.when(n > 8, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def n_twins(words: Column) -> Column:
    """Words equal to the one before."""
    return F.aggregate(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def base_rules(text: Column, words: Column) -> dict[str, Column]:
    return {
        "too_short": F.size(words) < 20,
        "repeated_windows": 100 * n_repeat_words(words) > 30 * F.size(words),
    }


def style_rules(text: Column, words: Column, symbol_share: float = 0.1, dup_lines: float = 0.4, word_length: tuple[float, float] = (2.0, 15.0), stutter: float = 0.3) -> dict[str, Column]:
    """Symbols per word, repeated lines, mean word length, and words equal to the one before."""
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "symbols": n_symbols(text) > symbol_share * n,
        "dup_lines": let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)) > dup_lines * F.size(x)),
        "word_length": let(word_chars(words) / n, lambda mean: (mean < word_length[0]) | (mean > word_length[1])),
        "stutter": n_twins(words) > stutter * n,
    }


def plan_cascade(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected), best rejection per cost first; ties and an empty sample keep the given order.

    docs has q_text and q_words. The sample is random over the whole table, about `sample_rows` rows.
    """
    rows = docs.select(F.count(F.lit(1))).first()[0]
    sample = docs.select("q_text", "q_words")
    if rows > sample_rows:
        sample = sample.sample(fraction=sample_rows / rows, seed=7)
    sample = materialize(sample, "rule-sample")
    hits = sample.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).alias(k) for k, c in rules.items()]).first()
    n = max(1, hits["n"])
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(rule: Column) -> float:
        best = float("inf")
        for _ in range(ROUNDS):
            began = time.perf_counter()
            many.agg(F.sum(rule.cast("int"))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    bare = seconds(F.length("q_text") + F.size("q_words") < 0)
    found = [(name, max(0.0, seconds(rule) - bare) / (n * TIMES), hits[name] / n) for name, rule in rules.items()]
    return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-9))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(rules[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _texts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """q_row (the columns to keep), q_text (null: empty) and q_words."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep], *([] if keep else [F.lit(1).alias("none")]))
    return docs.select(row.alias("q_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("q_text")).withColumn("q_words", words_of(F.col("q_text")))


def quality_verdicts(docs: DataFrame, text_col: str = "text", rules: dict[str, Column] | None = None) -> DataFrame:
    """The input's rows and columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by and kept.

    Null and empty texts have no words, fail the base and are not kept. Repeated rows get the same verdict.
    An empty table gives an empty result. An input column named like an added one gives way to it.
    """
    text, words = F.col("q_text"), F.col("q_words")
    rules = style_rules(text, words) if rules is None else rules
    keep = [c for c in docs.columns if c not in ADDED]
    split = _texts(docs, text_col, keep)
    order = [name for name, _, _ in plan_cascade(split, rules)]
    counted = split.withColumns(
        {"q_n": F.size(words).cast("long"), "q_chars": word_chars(words), "q_symbols": n_symbols(text), "q_dup": n_dup_lines(text), "q_repeat": n_repeat_words(words)}
    ).withColumn("q_base", (F.col("q_n") < 20) | (100 * F.col("q_repeat") > 30 * F.col("q_n")))
    judged = counted.withColumn("q_by", F.when(F.col("q_base"), "base").otherwise(cascade(rules, order)))
    added = [F.col(c).alias(n) for c, n in zip(["q_n", "q_chars", "q_symbols", "q_dup", "q_repeat", "q_base", "q_by"], ADDED)]
    return judged.select(*[F.col(f"q_row.`{c}`") for c in keep], *added, F.col("q_by").isNull().alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of documents that pass, all their columns unchanged, whatever those are called; the base rules are part of the cascade."""
    text, words = F.col("q_text"), F.col("q_words")
    rules = base_rules(text, words) | style_rules(text, words)
    split = _texts(docs, text_col, docs.columns)
    order = [name for name, _, _ in plan_cascade(split, rules)]
    judged = split.withColumn("q_by", cascade(rules, order))
    # observed counts are reported to query listeners; they also keep the optimizer from copying the whole
    # verdict into the filter, where array functions would be evaluated over and over
    watched = judged.observe("quality_filter", F.count(F.lit(1)).alias("judged"), F.sum(F.col("q_by").isNull().cast("int")).alias("kept"))
    return watched.where("q_by is null").select("q_row.*")
