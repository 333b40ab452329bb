"""A gated plan as lazy DataFrames: base, then main, sample and count over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from termwright.definitions import Store
from termwright.functions import predicates as P
from termwright.model import Model, flat
from termwright.operators import signals as S
from termwright.plans.gate import Passed
from termwright.plans.plan import DEFAULT_LIMIT, Plan


@dataclass
class Compiled:
    base: DataFrame
    main: DataFrame
    sample: DataFrame
    count: DataFrame
    limit: int


def compile_plan(model: Model, store: Store, plan: Plan, passed: Passed, tables: dict[str, DataFrame]) -> Compiled:
    """Joins only what the plan refers to; every value is a literal Column, no SQL text is built."""
    spec = model.entities[plan.entity]
    used: set[str] = set()
    members: dict[str, S.Member] = {}

    def column(ref: str) -> Column:
        ns, _, name = ref.rpartition(".")
        used.add(ns)
        return F.col(flat(ns, name))

    def term(name: str, basis: str | None) -> Column:
        d = store.get(name)
        built = S.build(model, store, d, plan.entity, model.lift(d.entity, plan.entity, basis or d.basis))
        used.update(ns for ns, _ in built.refs)
        members.update({m.column: m for m in built.members})
        return built.predicate()

    def clause(c: dict) -> Column:
        if "term" in c:
            return term(c["term"], c.get("basis"))
        if "not" in c:
            return ~clause(c["not"])
        if "attr" in c:
            return P.clause(column(c["attr"]), c["op"], c.get("value"), model.attribute(plan.entity, c["attr"]).type)
        return (P.any_of if "any_of" in c else P.all_of)([clause(x) for x in c.get("any_of") or c["all_of"]])

    where = [clause(c) for c in plan.where]
    if passed.seasons:
        where.append(F.col(spec.season).between(*passed.seasons))
    if spec.kind and passed.kinds and "*" not in passed.kinds:
        where.append(column(spec.kind).isin(passed.kinds))
    keys = {k.name: term(k.term, k.basis) if k.term else column(k.attr) for k in plan.group_by}
    values = {m.name: term(m.term, m.basis) if m.term else column(m.of) if m.of else None for m in plan.metrics}

    base = tables[plan.entity]
    for ns in sorted(used - {""}):
        join = spec.joins[ns]
        other = tables[join.entity]
        other = other.select(*[F.col(c).alias(flat(ns, c)) for c in other.columns])
        season = model.entities[join.entity].season
        on = [F.col(a) - join.lag == F.col(flat(ns, b)) if b == season and join.lag else F.col(a) == F.col(flat(ns, b)) for a, b in join.on]
        base = base.join(other, P.all_of(on), "left")
    for m in members.values():
        base = S.mark(model, base, m, tables[m.definition.entity])
    for w in where:
        base = base.where(w)
    # terms stand beside columns of the same name
    base = base.withColumns({f"key__{n}": c for n, c in keys.items()} | {f"of__{n}": c for n, c in values.items() if c is not None})

    aggregates = []
    for m in plan.metrics:
        x = F.col(f"of__{m.name}")
        if m.fn == "count":
            got = F.count(F.lit(1))
        elif m.term and m.fn == "avg":  # unknown rows count neither way
            got = F.avg(F.when(x, F.lit(1.0)).when(~x, F.lit(0.0)))
        elif m.term:
            got = F.countDistinct(F.when(x, F.lit(1)))
        else:
            got = {"count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[m.fn](x)
        aggregates.append(got.alias(m.name))
    grouped = base.groupBy(*[F.col(f"key__{n}").alias(n) for n in keys]) if keys else base.groupBy()
    called = {k.attr: k.name for k in plan.group_by if k.attr}  # an attribute stands for the group of that attribute
    ordered = [(by if by in keys or by in {m.name for m in plan.metrics} else called[by], down) for by, down in plan.order_by]
    order = [(F.desc_nulls_last if down else F.asc_nulls_last)(by) for by, down in ordered] + [F.asc_nulls_last(n) for n in keys if n not in {by for by, _ in ordered}]
    limit = plan.limit or DEFAULT_LIMIT
    rows = grouped.agg(*aggregates)
    main = (rows.orderBy(*order) if order else rows).limit(limit)
    shown = [spec.season, *spec.identifying, *spec.keys, *[flat(*r.rpartition(".")[::2]) for r in dict.fromkeys([c["attr"] for c in plan.where if "attr" in c])]]
    sample = base.orderBy(*[F.asc_nulls_last(c) for c in dict.fromkeys([spec.season, *spec.order, *spec.keys])]).select(*dict.fromkeys(shown)).limit(plan.sample_rows)
    return Compiled(base, main, sample, base.groupBy().agg(F.count(F.lit(1)).alias("n")), limit)
