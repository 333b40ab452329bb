"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from termwright.llm import byte_bpe, exact_dedup, lm, packing, quality, recompression, simhash, suffix_dedup, toxicity, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_docs(spark, sf_dir)).drop("kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_docs(spark, sf_dir))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_docs(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(_docs(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir)).drop("h", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_recompression, op2_simhash, op3_exact_dedup, op4_byte_bpe, op5_toxicity, op6_packing, op7_suffix_dedup, op8_quality_rules, op9_lm, op10_warc)}

ORACLE_SQL = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to FROM g
    """,
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT *, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g
    """,
    "op8_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(range(0, greatest(len(ws) - 7, 0))) AS i, ws FROM d),
        win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') AS w FROM u),
        dup AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
                FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS k FROM win) WHERE k > 1),
        rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS r FROM dup GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                     len(list_filter(list_zip(ws, ws[2:]), lambda p: p[1] = p[2])) AS twins
              FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.4 * n_lines OR word_chars < 2.0 * n_words
                    OR word_chars > 15.0 * n_words OR twins > 0.3 * n_words) AS kept
        FROM f
    """,
}
