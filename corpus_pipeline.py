"""Corpus pipeline: quality rules, exact dedup, near dedup, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from termwright.llm import exact_dedup, packing, quality, runtime, simhash, suffix_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.dedup_filter(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    return simhash.similar_filter(docs, words=5, least=0.8)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 50-byte strings that a smaller doc_id has; n_chars follows. A character that a cut splits goes whole."""
    cut = suffix_dedup.remove_repeats(docs, carry=[c for c in docs.columns if c != "text"], as_text=True)
    text = F.col("kept")
    cols = {c: F.col(f"carry.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    out = cut.select(*[cols[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and where they are packed."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", passages_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither SimHash classes nor packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name)
    return docs
