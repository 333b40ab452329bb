"""The five signals as Columns over the flat base row, with SQL's three-valued membership.

percentile and rank put rows into a cohort set; the set is computed over the whole entity table, joined to
the base as a marker, and the marker becomes true, false or unknown the way `(keys) IN (set)` does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from termwright.definitions import Definition, Store
from termwright.functions import predicates as P
from termwright.model import LiftError, Model, flat

NUMERIC = ("int", "float")
COMPARE = ("<", "<=", ">", ">=", "=", "!=")


@dataclass(frozen=True)
class Member:
    """Marker of a cohort set: joined on the keys as the plan's row has them behind a namespace."""

    name: str
    namespace: str
    definition: Definition

    @property
    def column(self) -> str:
        return f"in__{self.name}__{self.namespace}"


@dataclass
class Built:
    predicate: Callable[[], Column]
    refs: list[tuple[str, str]]
    members: list[Member]


def _spec(model: Model, d: Definition):
    return model.entities[d.entity]


def eligibility(model: Model, d: Definition) -> list[dict]:
    e = d.params.get("eligible")
    if e is None:
        return list(_spec(model, d).eligible)
    return e if isinstance(e, list) else e["rules"]


def validate(model: Model, store: Store, d: Definition, above: tuple[str, ...] = ()) -> list[str]:
    """Problems of a definition's parameters, against the catalog."""
    if d.entity not in model.entities:
        return [f"unknown entity {d.entity}"]
    if d.basis == "prior_season" and d.entity not in model.based:
        return [f"{d.entity} has no basis"]
    p, attr = d.params, lambda r: model.attribute(d.entity, r)

    def rules(items: list[dict]) -> list[str]:
        out = [] if items else ["at least one rule is needed"]
        for r in items:
            a = attr(r["attr"])
            out += [f"unknown attribute {r['attr']}"] if a is None else P.check(r["op"], r.get("value"), a.type)
        return out

    if d.signal == "rule":
        return rules(p.get("rules", [])) + ([] if p.get("match", "all") in ("all", "any") else ["match is all or any"])
    if d.signal in ("percentile", "rank"):
        out = [f"{c} must be the entity's own" for c in (p["attr"], *p.get("cohort", [])) if "." in c]
        out += [f"unknown attribute {c}" for c in (p["attr"], *p.get("cohort", [])) if attr(c) is None]
        if not out and attr(p["attr"]).type not in NUMERIC:
            out.append(f"{p['attr']} is not a number")
        if not p.get("cohort"):
            out.append("a cohort is needed")
        if p.get("direction", "top") not in ("top", "bottom"):
            out.append("direction is top or bottom")
        if d.signal == "percentile" and not 0 <= p.get("pctile", -1) <= 100:
            out.append("pctile is 0 to 100")
        if d.signal == "rank" and p.get("top_n", 0) < 1:
            out.append("top_n is at least 1")
        return out + (rules(eligibility(model, d)) if eligibility(model, d) else [])
    if d.signal == "delta":
        out = [f"{c} is not a number" for c in (p["attr"], p["baseline"]) if (a := attr(c)) is None or a.type not in NUMERIC]
        return out + ([] if p.get("kind") in ("ratio", "diff") else ["kind is ratio or diff"]) + ([] if p.get("op") in COMPARE else ["unknown operator"])
    terms = p.get("terms", [])
    if p.get("op") not in ("all_of", "any_of", "not") or not terms or len(set(terms)) != len(terms) or p["op"] == "not" and len(terms) != 1:
        return ["composite takes an op and distinct terms (not: one)"]
    out = []
    for t in terms:
        if t == d.name or t in above:
            return [f"{t} would rest on itself"]
        sub = store.get(t)
        if sub is None:
            out.append(f"term {t} has no valid definition")
            continue
        out += validate(model, store, sub, (*above, d.name))
        try:
            model.lift(sub.entity, d.entity, sub.basis)
        except LiftError as e:
            out.append(str(e))
    return out


def own_refs(model: Model, d: Definition) -> list[str]:
    p = d.params
    if d.signal == "rule":
        return [r["attr"] for r in p["rules"]]
    if d.signal == "delta":
        return [p["attr"], p["baseline"]]
    return [p["attr"], *p["cohort"], *(r["attr"] for r in eligibility(model, d))]


def requires(model: Model, store: Store, d: Definition) -> list[str]:
    """Attributes, in the definition's own terms, that must be there; an any_of needs none of its branches."""
    if d.signal != "composite":
        return own_refs(model, d)
    if d.params["op"] == "any_of":
        return []
    return branch_refs(model, store, d)


def prefers(model: Model, store: Store, d: Definition) -> list[str]:
    return branch_refs(model, store, d) if d.signal == "composite" and d.params["op"] == "any_of" else []


def branch_refs(model: Model, store: Store, d: Definition) -> list[str]:
    out = []
    for t in d.params["terms"]:
        sub = store.get(t)
        if sub is not None:
            names = model.lift(sub.entity, d.entity, sub.basis)
            out += [r for r in (lift_ref(names, x) for x in requires(model, store, sub)) if r not in out]
    return out


def lift_ref(names: dict[str, str], ref: str) -> str:
    ns, _, name = ref.rpartition(".")
    if ns not in names:
        raise LiftError(f"namespace {ns} has no meaning here")
    return f"{names[ns]}.{name}" if names[ns] else name


def build(model: Model, store: Store, d: Definition, plan_entity: str, names: dict[str, str]) -> Built:
    """A definition in a plan's row; names maps the definition's namespaces to the plan's."""
    refs: list[tuple[str, str]] = []

    def col(ref: str) -> Column:
        ns, _, name = lift_ref(names, ref).rpartition(".")
        refs.append((ns, name))
        return F.col(flat(ns, name))

    p = d.params
    if d.signal == "rule":
        parts = [(col(r["attr"]), r["op"], r.get("value"), model.attribute(d.entity, r["attr"]).type) for r in p["rules"]]
        join = P.any_of if p.get("match", "all") == "any" else P.all_of
        return Built(lambda: join([P.clause(*x) for x in parts]), refs, [])
    if d.signal == "delta":
        a, b = col(p["attr"]), col(p["baseline"])
        known = a.isNotNull() & b.isNotNull()
        if p.get("min_baseline") is not None:
            known = known & F.coalesce(b > float(p["min_baseline"]), F.lit(False))
        left, right = (a, b * float(p["value"])) if p["kind"] == "ratio" else (a - b, F.lit(float(p["value"])))
        return Built(lambda: known & F.coalesce(P.COMPARE[p["op"]](left, right), F.lit(False)), refs, [])
    if d.signal in ("percentile", "rank"):
        ns = names[""]
        keys = _spec(model, d).keys
        refs += [(ns, k) for k in keys]
        m = Member(d.name, ns, d)
        return Built(lambda: F.col(m.column), refs, [m])
    parts, members = [], []
    for t in p["terms"]:
        sub = store.get(t)
        inner = model.lift(sub.entity, d.entity, sub.basis)
        through = {k: lift_ref(names, f"{v}.x" if v else "x").rpartition(".")[0] for k, v in inner.items() if v in names or v == ""}
        if through.get("") is None:
            raise LiftError(f"{t} cannot be used through {d.name}")
        b = build(model, store, sub, plan_entity, through)
        parts.append(b.predicate)
        members += b.members
        refs += b.refs
    op = p["op"]
    return Built(lambda: ~parts[0]() if op == "not" else (P.all_of if op == "all_of" else P.any_of)([x() for x in parts]), refs, members)


def cohort(model: Model, d: Definition, table: DataFrame) -> DataFrame:
    """Keys of the rows in the set; ties at a percentile's edge are in or out together, ranks break ties by key."""
    p, keys = d.params, _spec(model, d).keys
    rows = table.where(P.all_of([F.col(c).isNotNull() for c in (p["attr"], *p["cohort"])]))
    for r in eligibility(model, d):
        rows = rows.where(P.clause(F.col(r["attr"]), r["op"], r.get("value"), model.attribute(d.entity, r["attr"]).type))
    top = p.get("direction", "top") == "top"
    if d.signal == "percentile":
        placed = with_cume_dist(rows, p["attr"], p["cohort"], top)
        return placed.where(F.col("place__") >= F.lit((float(p["pctile"]) if top else 100 - float(p["pctile"])) / 100)).select(*keys).distinct()
    within = Window.partitionBy(*p["cohort"])
    # a filter on row_number is pushed before the exchange as a limit for each cohort
    place = F.row_number().over(within.orderBy(F.desc(p["attr"]) if top else F.asc(p["attr"]), *[F.asc(k) for k in keys]))
    return rows.withColumn("place__", place).where(F.col("place__") <= p["top_n"]).select(*keys).distinct()


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises: 256 for each doubling, the same for all data."""
    v = value.cast("double")
    wide = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(1 << 40))).otherwise(F.floor(F.log1p(F.abs(v)) * (256 / math.log(2))).cast("double"))
    return (F.when(v < 0, -wide - 1).otherwise(wide)).cast("long")


def with_cume_dist(rows: DataFrame, attr: str, cohort: list[str], ascending: bool) -> DataFrame:
    """Adds place__, the share of the cohort's rows up to this one and its ties, without sorting a cohort in one task.

    Rows are counted by cohort and bucket of values; the counts of buckets, of which a cohort has few, are summed up
    in order, and only the rows of one bucket are sorted together.
    """
    rows = rows.withColumn("bucket__", bucket(F.col(attr)) if ascending else -bucket(F.col(attr)))
    by = Window.partitionBy(*cohort)
    counts = rows.groupBy(*cohort, "bucket__").agg(F.count(F.lit(1)).alias("n__"))
    before = F.sum("n__").over(by.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n__")
    sums = counts.withColumns({"before__": before, "all__": F.sum("n__").over(by)}).drop("n__")
    own = Window.partitionBy(*cohort, "bucket__").orderBy(F.asc(attr) if ascending else F.desc(attr)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("own__", F.count(F.lit(1)).over(own)).join(sums, [*cohort, "bucket__"])
    return placed.withColumn("place__", (F.col("before__") + F.col("own__")) / F.col("all__"))


def mark(model: Model, base: DataFrame, m: Member, table: DataFrame) -> DataFrame:
    """The base row with the member's column: true, false, or unknown where the lifted keys are null."""
    keys = _spec(model, m.definition).keys
    found = cohort(model, m.definition, table)
    side = found.select(*[F.col(k).alias(f"{m.column}__{k}") for k in keys], F.lit(True).alias(f"{m.column}__hit"))
    mine = [F.col(flat(m.namespace, k)) for k in keys]
    joined = base.join(side, P.all_of([a == F.col(f"{m.column}__{k}") for a, k in zip(mine, keys)]), "left")
    hit = F.coalesce(F.col(f"{m.column}__hit"), F.lit(False))
    if m.namespace:  # behind a LEFT JOIN the keys can be missing, all at once
        some = found.select((F.count(F.lit(1)) > 0).alias("some")).scalar()
        hit = F.when(P.any_of([a.isNull() for a in mine]), F.when(some, F.lit(None).cast("boolean")).otherwise(F.lit(False))).otherwise(hit)
    return joined.withColumn(m.column, hit).drop(*[f"{m.column}__{k}" for k in keys], f"{m.column}__hit")
