"""From a JSON plan to an answer that explains itself, or to a refusal."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from termwright.definitions import Store
from termwright.model import LiftError, Model
from termwright.operators.coverage import Coverage
from termwright.plans import gate
from termwright.plans.compile import Compiled, compile_plan
from termwright.plans.plan import PlanError, english, parse


class QueryTimeout(RuntimeError):
    """The statement ran longer than allowed; the session goes on."""


def collect(df: DataFrame, seconds: float) -> list[dict]:
    """Rows of a bounded result, cancelled by job group after `seconds`."""
    sc, group, late = df.sparkSession.sparkContext, uuid.uuid4().hex, threading.Event()
    sc.setJobGroup(group, "termwright query", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobGroup(group)))
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def prepare(model: Model, store: Store, raw: dict, tables: dict[str, DataFrame], coverage: Coverage | None = None) -> tuple[Compiled, gate.Passed] | gate.Refused:
    """Parse, gate and compile."""
    try:
        plan = parse(raw)
    except PlanError as e:
        return gate.Refused("invalid_plan", e.problems)
    passed = gate.check(model, store, plan, coverage)
    if isinstance(passed, gate.Refused):
        return passed
    try:
        return compile_plan(model, store, plan, passed, tables), passed
    except LiftError as e:
        return gate.Refused("entity_mismatch", [str(e)])


def query(spark: SparkSession, model: Model, store: Store, raw: dict, tables: dict[str, DataFrame], coverage: Coverage | None = None, seconds: float = 30) -> dict[str, Any]:
    """The envelope: rows, sample, counts, definitions, seasons, the plan in words and as Spark sees it."""
    store.refresh()
    got = prepare(model, store, raw, tables, coverage)
    if isinstance(got, gate.Refused):
        return {"ok": False, "error": asdict(got)}
    compiled, passed = got
    out, timing = {}, {}
    compiled.base.persist()  # three statements over the same rows
    try:
        for name, df in (("rows", compiled.main), ("sample", compiled.sample), ("count", compiled.count)):
            began = time.perf_counter()
            out[name] = collect(df, seconds)
            timing[name] = round(time.perf_counter() - began, 3)
    except QueryTimeout as e:
        return {"ok": False, "error": {"code": "sql_timeout", "problems": [str(e)], "next_step": None}}
    finally:
        compiled.base.unpersist()
    return {
        "ok": True, "question": raw.get("question"), "english": english(parse(raw)), "rows": out["rows"], "truncated": len(out["rows"]) == compiled.limit, "sample": out["sample"], "matched": out["count"][0]["n"],
        "definitions_used": [store.explain(d.name) for d in passed.used], "seasons": passed.seasons, "excluded": passed.excluded, "warnings": passed.warnings, "timing": timing,
        "plan": compiled.main._jdf.queryExecution().optimizedPlan().toString(),
    }
