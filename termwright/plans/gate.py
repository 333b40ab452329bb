"""The gate: a plan runs only if every word, column and season in it can be answered; else a refusal that says why."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

from termwright.definitions import Definition, Store
from termwright.functions import predicates as P
from termwright.model import LiftError, Model
from termwright.operators import signals as S
from termwright.operators.coverage import Coverage
from termwright.plans.plan import MAX_LIMIT, MAX_SAMPLE, Plan, walk


@dataclass
class Passed:
    seasons: tuple[int, int] | None
    kinds: list[str] | None
    warnings: list[str] = field(default_factory=list)
    used: list[Definition] = field(default_factory=list)
    excluded: list[int] = field(default_factory=list)


@dataclass
class Refused:
    code: str
    problems: list
    next_step: str | None = None


def terms(plan: Plan) -> list[tuple[str, str | None]]:
    out = [(c["term"], c.get("basis")) for c in walk(plan.where) if "term" in c]
    out += [(k.term, k.basis) for k in plan.group_by if k.term] + [(m.term, m.basis) for m in plan.metrics if m.term]
    return list(dict.fromkeys(out))


def refs(plan: Plan) -> list[str]:
    out = [c["attr"] for c in walk(plan.where) if "attr" in c] + [k.attr for k in plan.group_by if k.attr] + [m.of for m in plan.metrics if m.of]
    return list(dict.fromkeys(out))


def check(model: Model, store: Store, plan: Plan, coverage: Coverage | None = None) -> Passed | Refused:
    spec = model.entities.get(plan.entity)
    if spec is None:
        return Refused("invalid_plan", [f"unknown entity {plan.entity}"])
    kinds = list(model.default_kinds) if plan.kinds is None else plan.kinds
    if plan.limit is not None and not 1 <= plan.limit <= MAX_LIMIT:
        return Refused("invalid_plan", [f"limit is 1 to {MAX_LIMIT}"])
    if not 0 <= plan.sample_rows <= MAX_SAMPLE:
        return Refused("invalid_plan", [f"sample_rows is 0 to {MAX_SAMPLE}"])
    if not kinds or set(kinds) - {*model.kinds, "*"}:
        return Refused("invalid_plan", [f"game_types are {', '.join(model.kinds)} or *"])
    # columns, all of them
    made = {k.name for k in plan.group_by} | {m.name for m in plan.metrics}
    wanted = refs(plan) + [by for by, _ in plan.order_by if by not in made]
    unknown = [r for r in wanted if model.attribute(plan.entity, r) is None]
    if unknown:
        known = list(spec.attributes) + [f"{ns}.{a}" for ns, j in spec.joins.items() for a in model.entities[j.entity].attributes]
        return Refused("unknown_attribute", [{"name": u, "did_you_mean": difflib.get_close_matches(u, known, 3)} for u in unknown])
    problems = [x for c in walk(plan.where) if "attr" in c for x in P.check(c["op"], c.get("value"), model.attribute(plan.entity, c["attr"]).type)]
    problems += [f"{m.fn} of {m.of} has no meaning" for m in plan.metrics if m.fn in ("sum", "avg") and m.of and model.attribute(plan.entity, m.of).type not in S.NUMERIC]
    keys = made | {k.attr for k in plan.group_by if k.attr}
    problems += [f"order_by {by} is neither a group nor a metric" for by, _ in plan.order_by if by not in keys]
    if problems:
        return Refused("invalid_plan", problems)
    # words
    names = terms(plan)
    broken = [{"term": t, "why": store.broken[t]} for t, _ in names if t in store.broken]
    missing = [t for t, _ in names if store.get(t) is None and t not in store.broken]
    if missing:
        return Refused("unresolved_term", [store.propose(t, plan.entity) for t in missing], "propose_definition, then save_definition")
    if broken:
        return Refused("definition_broken", broken)
    for t, basis in names:
        d = store.get(t)
        if basis and d.entity not in model.based:
            return Refused("invalid_plan", [f"{t} has no basis"])
        try:
            model.lift(d.entity, plan.entity, basis or d.basis)
        except LiftError as e:
            return Refused("entity_mismatch", [{"term": t, "why": str(e), "allowed": sorted({b for a, b in model.lifts if a == d.entity} | {d.entity})}])
    passed = Passed(plan.seasons, kinds)
    for t, _ in names:
        passed.used += [d for d in store.used(t) if d not in passed.used]
    if spec.kind is None and plan.kinds is not None:
        passed.warnings.append(f"game_types do not apply to {plan.entity}")
    return seasons(model, store, plan, coverage, passed) if coverage else passed


def seasons(model: Model, store: Store, plan: Plan, coverage: Coverage, passed: Passed) -> Passed | Refused:
    """Intersect what all columns can answer, each lag group shifted by its lag."""
    spec = model.entities[plan.entity]
    need: list[str] = refs(plan)
    soft: list[str] = []
    for t, basis in terms(plan):
        d = store.get(t)
        names = model.lift(d.entity, plan.entity, basis or d.basis)
        need += [S.lift_ref(names, r) for r in S.requires(model, store, d)]
        soft += [S.lift_ref(names, r) for r in S.prefers(model, store, d)]
    groups: dict[int, list[tuple[str, str]]] = {}
    for r in need:
        ns, _, name = r.rpartition(".")
        where = spec.joins[ns].entity if ns else plan.entity
        groups.setdefault(model.lag(plan.entity, ns), []).append((where, name))
    q = coverage.queryable()
    if not q:
        return Refused("coverage_gap", ["no season can be queried"])
    lo, hi = q[0], q[-1]
    for lag, cols in groups.items():
        cols = list(dict.fromkeys(cols))
        # facts reach below the floor for lagged columns: only queryable seasons of the plan matter
        found = [coverage.columns.get(c) for c in cols]
        if any(c is None or not c["non_null"] for c in found):
            return Refused("coverage_gap", [{"limiting": [c for c, f in zip(cols, found) if f is None or not f["non_null"]], "available": None}])
        dated = [c for c in found if c["first_season"] is not None]
        lo = max([lo, *(c["first_season"] + lag for c in dated)])
        hi = min([hi, *(c["last_season"] + lag for c in dated)])
    rows = limiting(groups, coverage)
    if lo > hi:
        return Refused("coverage_gap", [{"available": None, "why": "the columns share no season", "limiting": rows}])
    ask = plan.seasons or (q[0], q[-1])
    got = (max(ask[0], lo), min(ask[1], hi))
    if got[0] > got[1]:
        return Refused("coverage_gap", [{"available": [lo, hi], "asked": list(ask), "limiting": rows, "why": why_excluded(rows, lo, hi)}])
    passed.excluded = [s for s in range(ask[0], ask[1] + 1) if not got[0] <= s <= got[1]]
    if passed.excluded:
        if plan.seasons and not plan.allow_partial_coverage:
            return Refused("coverage_gap", [{"available": [lo, hi], "asked": list(ask), "excluded": passed.excluded, "limiting": rows, "why": why_excluded(rows, lo, hi)}], "ask for the available seasons or allow_partial_coverage")
        passed.warnings.append(f"seasons {passed.excluded} are not covered and left out: {why_excluded(rows, lo, hi)}")
    passed.seasons = got
    passed.warnings += [f"season {s} is in progress" for s, r in sorted(coverage.seasons.items()) if r["in_progress"] and got[0] <= s <= got[1]]
    for r in soft:
        ns, _, name = r.rpartition(".")
        c = coverage.columns.get((spec.joins[ns].entity if ns else plan.entity, name))
        if c and c["first_season"] and c["first_season"] + model.lag(plan.entity, ns) > got[0]:
            passed.warnings.append(f"{r} starts in {c['first_season']}")
    passed.warnings += [f"{e}.{n} has gaps" for cols in groups.values() for e, n in dict.fromkeys(cols) if coverage.columns[(e, n)]["has_gaps"]]
    return passed


def limiting(groups: dict[int, list[tuple[str, str]]], coverage: Coverage) -> list[dict]:
    """The columns that need seasons, with the plan's seasons each can answer: those that start last come first."""
    rows = []
    for lag, cols in groups.items():
        for c in dict.fromkeys(cols):
            f = coverage.columns.get(c)
            if f is not None and f["first_season"] is not None:
                rows.append({"column": ".".join(c), "first": f["first_season"] + lag, "last": f["last_season"] + lag, "lag": lag})
    return sorted(rows, key=lambda r: (-r["first"], r["last"], r["column"]))


def why_excluded(rows: list[dict], lo: int, hi: int) -> str:
    """What pushed the seasons in; a column of another season than the row's is named as that, not as a hole in the data."""
    edge = [r for r in rows if r["first"] == lo or r["last"] == hi]
    for r in sorted(edge, key=lambda r: r["lag"] == 0):
        if r["lag"]:
            away = f"{abs(r['lag'])} season{'s' * (abs(r['lag']) > 1)} {'back' if r['lag'] > 0 else 'ahead'}"
            return f"{r['column']} is read {away}, and its data are from {r['first'] - r['lag']} to {r['last'] - r['lag']}"
        return f"{r['column']} has data from {r['first']} to {r['last']}"
    return "no column used has data there"


def coverage_of(model: Model, store: Store, name: str, coverage: Coverage) -> tuple[int, int] | None:
    """Seasons in which a definition's own columns all have data; None for an unknown definition or a column without data."""
    d = store.get(name)
    if d is None:
        return None
    return coverage.intersect([(d.entity, r) for r in S.requires(model, store, d) if "." not in r])
