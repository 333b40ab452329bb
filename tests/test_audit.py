from datetime import datetime, timedelta, timezone

import pytest

from termwright import audit as A

NOW = datetime(2024, 5, 10, 12, tzinfo=timezone.utc)
PLAN = {"entity": "x", "where": [{"any_of": [{"term": "cheap"}, {"not": {"term": "dear"}}]}], "metrics": [{"fn": "avg", "of": {"term": "cheap"}}], "question": "why"}


def test_log_and_usage(spark, tmp_path):
    path = tmp_path / "log" / "audit.jsonl"
    A.record(path, "query", PLAN, {"ok": True, "rows": [1, 2]}, 0.5, NOW)
    A.record(path, "query", {**PLAN, "question": "else"}, {"ok": True, "rows": []}, 1.5, NOW - timedelta(days=3))
    A.record(path, "query", PLAN, {"ok": False, "error": {"code": "unresolved_term", "problems": [{"term": "dear"}]}}, 0.1, NOW)
    A.record(path, "raw_sql", {}, {"ok": False}, 0.2, NOW)
    with path.open("a") as f:
        f.write("not json\n\n[1]\n")
    log = A.read(spark, str(path))
    assert log.count() == 4 and A.read(spark, str(path), A.since("2d", NOW)).count() == 3
    assert {(r.term, r.answered, r.refused, r.missing) for r in A.term_usage(log).collect()} == {("cheap", 2, 1, 0), ("dear", 2, 1, 1)}
    assert {(r.tool, r.outcome, r.calls, r.plans, r.median_seconds, r.longest_seconds) for r in A.summary(log).collect()} == {("query", "ok", 2, 1, 1.0, 1.5), ("query", "unresolved_term", 1, 1, 0.1, 0.1), ("raw_sql", "failed", 1, 1, 0.2, 0.2)}


def test_auditing_never_raises(tmp_path):
    (tmp_path / "file").write_text("")
    A.record(tmp_path / "file" / "log", "query", {"a": object()}, {"ok": True}, 1.0)
    A.record(tmp_path / "log", "query", {}, {"rows": None}, 1.0)


def test_fingerprint_and_since():
    assert A.fingerprint(PLAN) == A.fingerprint(dict(reversed(PLAN.items()))) != A.fingerprint({**PLAN, "limit": 1})
    assert A.since("90m", NOW) == NOW - timedelta(minutes=90) and A.since("2w", NOW) == NOW - timedelta(weeks=2)
    assert A.since("2024-05-01", NOW) == datetime(2024, 5, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        A.since("soon")
