"""Entities (row grains), their to-one joins, attributes and lifts: everything the engine knows about a domain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TYPES = ("int", "float", "bool", "str", "date")


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    family: str = "general"
    description: str = ""
    seasonal: bool = True


@dataclass(frozen=True)
class Join:
    """A LEFT JOIN to at most one row of another entity; lag shifts the season (1: the season before)."""

    entity: str
    on: tuple[tuple[str, str], ...]
    lag: int = 0


@dataclass(frozen=True)
class Entity:
    name: str
    keys: tuple[str, ...]
    identifying: tuple[str, ...]
    attributes: dict[str, Attribute]
    joins: dict[str, Join] = field(default_factory=dict)
    season: str = "season"
    order: tuple[str, ...] = ()
    #: Where the game type is: a column, "namespace.column", or None for coarse entities.
    kind: str | None = None
    eligible: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Model:
    name: str
    entities: dict[str, Entity]
    #: (definition's entity, plan's entity) -> its namespaces in the plan's terms; "" is the entity itself.
    lifts: dict[tuple[str, str], dict[str, str]]
    kinds: tuple[str, ...]
    default_kinds: tuple[str, ...]
    #: Entities whose definitions have a basis (current or prior season).
    based: tuple[str, ...]
    tables: Callable[[object, str], dict[str, DataFrame]]

    def attribute(self, entity: str, ref: str) -> Attribute | None:
        """The attribute behind `name` or `namespace.name`; None if there is none."""
        spec = self.entities[entity]
        ns, dot, name = ref.rpartition(".")
        if dot:
            join = spec.joins.get(ns)
            return self.entities[join.entity].attributes.get(name) if join else None
        return spec.attributes.get(name)

    def lift(self, defined_on: str, plan_entity: str, basis: str | None) -> dict[str, str]:
        """Namespace map for using a definition in a finer plan; raises LiftError where that has no meaning."""
        prior = basis == "prior_season"
        if defined_on == plan_entity:
            spec = self.entities[plan_entity]
            own = {ns: ns for ns in spec.joins}
            if not prior:
                return {"": ""} | own
            if "prior" not in spec.joins:
                raise LiftError(f"{plan_entity} has no prior season")
            return {"": "prior"}
        found = self.lifts.get((defined_on, plan_entity))
        if found is None:
            raise LiftError(f"a definition on {defined_on} cannot be used in a plan on {plan_entity}")
        if prior:
            if "prior" not in found:
                raise LiftError(f"{defined_on} has no prior season in {plan_entity}")
            return {"": found["prior"]}
        return found

    def lag(self, entity: str, namespace: str) -> int:
        return self.entities[entity].joins[namespace].lag if namespace else 0


class LiftError(ValueError):
    """A definition cannot be used at the plan's grain."""


def flat(namespace: str, name: str) -> str:
    """Column name of an attribute behind a join, in the flat base row."""
    return f"{namespace}__{name}" if namespace else name


def attributes(**families: str) -> dict[str, Attribute]:
    """Attributes from "family" = "name:type name:type ..." text."""
    out = {}
    for family, text in families.items():
        for item in text.split():
            name, kind = item.split(":")
            out[name] = Attribute(name, kind, family)
    return out
