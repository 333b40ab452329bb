"""Exact deduplication with a heavy-hitter split.

A frequent-items sketch of the Misra-Gries family (approx_top_k: fixed number of counters, merged across
tasks) names digests that may be frequent. One exact pass over those alone gives their true counts and
smallest id; those with more rows than there are rows for each counter are verified winners. They are a bounded
table, which is broadcast and settles every copy of a hot text on the map side. All other digests go through an
ordinary shuffle, where no group can be larger than the sketch's error bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from termwright.llm.runtime import SPACE, id_text, materialize


def frequent_digests(digests: DataFrame, counters: int, heavy: int) -> DataFrame:
    """At most `heavy` digests that the sketch holds and that have more than rows / counters rows, with exact count and smallest doc_id."""
    floor = digests.count() // counters
    found = digests.select(F.explode(F.expr(f"approx_top_k(text_sha256, {heavy}, {counters})")).alias("x"))
    names = found.select(F.col("x.item").alias("text_sha256")).where("text_sha256 is not null")
    return (
        digests.join(F.broadcast(names), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > max(1, floor))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 2048, heavy: int = 512) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; a null text counts as
    empty, so null and empty texts form one group. The smallest doc_id of a group stays; null ids never win
    against an id, and a group of null ids only keeps its rows. Rows that repeat a doc_id with the same text
    are the same document and get the same verdict. An empty table gives an empty result. Other columns are
    ignored. At most `heavy` (a hard bound) winners are broadcast.
    """
    if heavy > counters:
        raise ValueError("heavy must not exceed counters")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    digests = materialize(id_text(docs, id_col, text_col).select("doc_id", F.sha2(text, 256).alias("text_sha256")), "digests")
    winners = materialize(frequent_digests(digests, counters, heavy), "winners")
    hot = digests.join(F.broadcast(winners), "text_sha256")
    w = Window.partitionBy("text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "text_sha256", "doc_id", F.min("doc_id").over(w).alias("keep_id"), F.count(F.lit(1)).over(w).alias("group_size")
    )
    both = hot.select("text_sha256", "doc_id", "keep_id", "group_size").unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all their columns unchanged, whatever those are called; rows with the same id and text both stay."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.sha2(normal, 256).alias("row_sha"))
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s")).distinct()
    return whole.join(gone, F.col("row_id").eqNullSafe(F.col("d")) & (F.col("row_sha") == F.col("s")), "left_anti").select("row.*")
