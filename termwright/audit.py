"""The audit log: one JSON line for each answer, and what it says about the use of terms, as DataFrames."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "at timestamp, tool string, ok boolean, code string, fingerprint string, terms array<string>, missing array<string>, rows long, seconds double"


def fingerprint(plan: dict) -> str:
    """The same for plans that differ only in the order of their keys, or in the question they come with."""
    bare = {k: v for k, v in plan.items() if k != "question"}
    return hashlib.sha256(json.dumps(bare, sort_keys=True, default=str).encode()).hexdigest()[:16]


def terms_of(thing: Any) -> list[str]:
    """All terms a plan names, wherever they stand."""
    found: set[str] = set()

    def walk(x: Any) -> None:
        if isinstance(x, dict):
            if isinstance(x.get("term"), str):
                found.add(x["term"])
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(thing)
    return sorted(found)


def record(path: Path, tool: str, plan: dict, answer: dict, seconds: float, now: datetime | None = None) -> None:
    """Appends a line. Auditing never stops an answer: what goes wrong here is let go."""
    try:
        error = answer.get("error") or {}
        missing = [p["term"] for p in error.get("problems", []) if isinstance(p, dict) and "term" in p] if error.get("code") == "unresolved_term" else []
        line = {
            "at": (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "tool": tool, "ok": bool(answer.get("ok")), "code": error.get("code"), "fingerprint": fingerprint(plan),
            "terms": terms_of(plan), "missing": missing, "rows": len(answer.get("rows", [])), "seconds": round(float(seconds), 3),
        }
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(line, ensure_ascii=False) + "\n")
    except Exception:  # noqa: BLE001
        return


def since(text: str, now: datetime | None = None) -> datetime:
    """A point in time: 90m, 12h, 7d, 2w before now, or a date."""
    now = now or datetime.now(timezone.utc)
    if m := re.fullmatch(r"(\d+)([mhdw])", text.strip()):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return now - timedelta(**{unit: int(m[1])})
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        raise ValueError(f"{text!r} is neither a span such as 7d nor a date") from None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def read(spark: SparkSession, path: str, start: datetime | None = None) -> DataFrame:
    """The log's lines from `start` on; lines that are no records are left out."""
    log = spark.read.schema(f"{SCHEMA}, broken__ string").option("columnNameOfCorruptRecord", "broken__").json(path).cache()
    rows = log.where("broken__ is null and at is not null").drop("broken__")
    return rows if start is None else rows.where(F.col("at") >= F.lit(start))


def term_usage(log: DataFrame) -> DataFrame:
    """term, answered and refused plans that name it, how often it was missing, and when last."""
    used = log.select(F.explode("terms").alias("term"), "ok", "at", F.lit(0).alias("gone"))
    gone = log.select(F.explode("missing").alias("term"), F.lit(None).cast("boolean").alias("ok"), "at", F.lit(1).alias("gone"))
    return used.unionByName(gone).groupBy("term").agg(F.count(F.when(F.col("ok"), 1)).alias("answered"), F.count(F.when(~F.col("ok"), 1)).alias("refused"), F.sum("gone").alias("missing"), F.max("at").alias("last"))


def summary(log: DataFrame) -> DataFrame:
    """By tool and outcome: calls, distinct plans, median and longest time."""
    outcome = F.when(F.col("ok"), "ok").otherwise(F.coalesce("code", F.lit("failed"))).alias("outcome")
    return log.groupBy("tool", outcome).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("fingerprint").alias("plans"), F.expr("percentile(seconds, 0.5)").alias("median_seconds"), F.max("seconds").alias("longest_seconds"))
