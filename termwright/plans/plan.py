"""Structured plans: parsing and the shape checks that need no catalog."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

METRICS = ("count", "count_distinct", "sum", "avg", "min", "max")
MAX_LIMIT, DEFAULT_LIMIT, SAMPLE_ROWS, MAX_SAMPLE = 1000, 200, 10, 50


class PlanError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Metric:
    fn: str
    of: str | None = None
    term: str | None = None
    basis: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        what = self.term or self.of
        return self.alias or (f"{self.fn}_{what.replace('.', '__')}" if what else self.fn)


@dataclass(frozen=True)
class Key:
    attr: str | None = None
    term: str | None = None
    basis: str | None = None

    @property
    def name(self) -> str:
        return self.term or self.attr.replace(".", "__")


@dataclass
class Plan:
    entity: str
    where: list[dict] = field(default_factory=list)
    seasons: tuple[int, int] | None = None
    kinds: list[str] | None = None
    group_by: list[Key] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    sample_rows: int = SAMPLE_ROWS
    allow_partial_coverage: bool = False
    question: str | None = None


CLAUSES = {"term": {"term", "basis"}, "attr": {"attr", "op", "value"}, "not": {"not"}, "any_of": {"any_of"}, "all_of": {"all_of"}}


def parse(raw: dict[str, Any]) -> Plan:
    """A plan from JSON; raises PlanError with up to ten problems."""
    problems: list[str] = []
    known = {"entity", "where", "seasons", "game_types", "group_by", "metrics", "order_by", "limit", "sample_rows", "allow_partial_coverage", "question"}
    problems += [f"unknown field {k}" for k in sorted(set(raw) - known)]

    def clause(c: Any) -> None:
        if not isinstance(c, dict) or len(kind := [k for k in CLAUSES if k in c]) != 1 or set(c) - CLAUSES[kind[0]]:
            problems.append(f"not a clause: {c!r}")
        elif kind[0] in ("any_of", "all_of"):
            if not c[kind[0]]:
                problems.append(f"{kind[0]} needs clauses")
            for x in c[kind[0]]:
                clause(x)
        elif kind[0] == "not":
            clause(c["not"])
        elif kind[0] == "attr" and "op" not in c:
            problems.append(f"{c['attr']} has no op")

    for c in raw.get("where", []):
        clause(c)
    keys = [Key(attr=k) if isinstance(k, str) else Key(k.get("attr"), k.get("term"), k.get("basis")) for k in raw.get("group_by", [])]
    metrics = []
    for m in raw.get("metrics", [{"fn": "count"}]):
        of = m.get("of")
        metric = Metric(m.get("fn"), of if isinstance(of, str) else None, of.get("term") if isinstance(of, dict) else None, of.get("basis") if isinstance(of, dict) else None, m.get("as"))
        if metric.fn not in METRICS or set(m) - {"fn", "of", "as"}:
            problems.append(f"unknown metric {m!r}")
        elif metric.fn != "count" and not (metric.of or metric.term):
            problems.append(f"{metric.fn} needs an attribute or a term")
        elif metric.fn == "count" and of is not None:
            problems.append("count takes nothing")
        elif metric.term and metric.fn not in ("avg", "count_distinct"):
            problems.append(f"{metric.fn} of a term has no meaning")
        metrics.append(metric)
    names = [k.name for k in keys] + [m.name for m in metrics if m.fn in METRICS]
    problems += [f"{n} is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
    order = [(o, False) if isinstance(o, str) else (o.get("by", o.get("key")), o.get("dir", "asc") == "desc") for o in raw.get("order_by", [])]
    if "entity" not in raw:
        problems.append("no entity")
    if problems:
        raise PlanError(problems[:10])
    seasons = raw.get("seasons")
    return Plan(raw["entity"], raw.get("where", []), tuple(seasons) if seasons else None, raw.get("game_types"), keys, metrics, order, raw.get("limit"), raw.get("sample_rows", SAMPLE_ROWS), raw.get("allow_partial_coverage", False), raw.get("question"))


def walk(clauses: list[dict]):
    """Every leaf clause."""
    for c in clauses:
        if "not" in c:
            yield from walk([c["not"]])
        elif "any_of" in c or "all_of" in c:
            yield from walk(c.get("any_of") or c["all_of"])
        else:
            yield c


def english(plan: Plan) -> str:
    """The plan as a sentence."""

    def say(c: dict) -> str:
        if "term" in c:
            return c["term"].replace("_", " ") + (" the season before" if c.get("basis") == "prior_season" else "")
        if "attr" in c:
            return f"{c['attr']} {c['op'].replace('_', ' ')} {c.get('value', '')}".strip()
        if "not" in c:
            return f"not ({say(c['not'])})"
        return "(" + (" or " if "any_of" in c else " and ").join(map(say, c.get("any_of") or c["all_of"])) + ")"

    text = ", ".join(m.name for m in plan.metrics) + f" of {plan.entity}"
    text += " where " + " and ".join(map(say, plan.where)) if plan.where else ""
    text += " by " + ", ".join(k.name for k in plan.group_by) if plan.group_by else ""
    return text
