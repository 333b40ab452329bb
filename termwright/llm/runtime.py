"""Shared folders, lineage cuts and the input view that every operator starts from."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Python-side white space of the contracts: \x20 and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"

#: Where intermediate tables go only when the session names no shared folder (tests on one machine).
LOCAL_DEFAULT = "/tmp/termwright-shared"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or the context's checkpoint folder, or a local default on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not set_.isEmpty():
        return set_.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("intermediate tables need a folder that driver and executors share: set spark.checkpoint.dir")
    return LOCAL_DEFAULT


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/termwright-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that extra columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a few rows at a time, about `limit` bytes: a batch can hold thousands of long texts."""
    keys, texts, size = [], [], 0
    for b in batches:
        for i in range(b.num_rows):
            keys.append(b.column(0)[i].as_py())
            texts.append(b.column(1)[i].as_py() or "")
            size += len(texts[-1])
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
