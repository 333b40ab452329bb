"""The twelve rule operators: validation against the catalog's types, and their Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

#: The operators of a rule.
OPS = ("=", "!=", "<", "<=", ">", ">=", "in", "not_in", "between", "is_null", "is_not_null", "like")
COMPARE = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}


@dataclass(frozen=True)
class Kind:
    """An attribute's type: which JSON values may stand beside it, and how they become literals."""

    accepts: Callable[[Any], bool]
    literal: Callable[[Any], Column] = F.lit


def number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not truth(value)


def truth(value: Any) -> bool:
    return value is True or value is False


def text(value: Any) -> bool:
    return isinstance(value, str)


KINDS = {
    "bool": Kind(truth),
    "date": Kind(text, lambda value: F.lit(value).cast("timestamp")),
    "float": Kind(number, lambda value: F.lit(float(value))),
    "int": Kind(lambda value: number(value) and not isinstance(value, float)),
    "str": Kind(text),
}


def fits(value: Any, kind: str) -> bool:
    """Whether a JSON value may stand beside an attribute of this type; a bool is never a number."""
    return KINDS[kind].accepts(value)


def check(op: str, value: Any, kind: str) -> list[str]:
    """What is wrong with `op value` on an attribute of this type."""
    if op not in OPS:
        return [f"unknown operator {op!r}"]
    if op in ("is_null", "is_not_null"):
        return [] if value is None else [f"{op} takes no value"]
    if op in ("in", "not_in", "between"):
        if not isinstance(value, (list, tuple)) or not value or op == "between" and len(value) != 2:
            return [f"{op} takes {'two values' if op == 'between' else 'a list of values'}"]
        return [f"{v!r} is not {kind}" for v in value if not fits(v, kind)]
    if op == "like" and kind != "str":
        return ["like takes a text attribute"]
    return [] if fits(value, kind) else [f"{value!r} is not {kind}"]


def literal(value: Any, kind: str) -> Column:
    return KINDS[kind].literal(value)


def clause(column: Column, op: str, value: Any, kind: str) -> Column:
    """One clause; unknown (null) stays unknown as in SQL."""
    if op in COMPARE:
        return COMPARE[op](column, literal(value, kind))
    if op in ("in", "not_in"):
        inside = column.isin(*[literal(v, kind) for v in value])
        return inside if op == "in" else ~inside
    if op == "between":
        return column.between(literal(value[0], kind), literal(value[1], kind))
    if op == "like":
        return column.like(value)
    return column.isNull() if op == "is_null" else column.isNotNull()


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts)


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts)


def blank_to_null(column: Column) -> Column:
    """Text trimmed, and blank text as null."""
    return F.nullif(F.trim(column), F.lit(""))


def code_map(column: Column, codes: dict[str, str], keep_unknown: bool) -> Column:
    """Codes translated; an unknown code stays itself or becomes null."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    found = F.try_element_at(table, column)
    return F.coalesce(found, column) if keep_unknown else found


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division by zero."""
    return top / F.nullif(bottom, F.lit(0))


def last_mean(column: Column, window, n: int = 4) -> tuple[Column, Column]:
    """Mean and number of the last n non-null values before the row."""
    lags = F.array_compact(F.array(*[F.lag(F.when(column.isNotNull(), column), k).over(window) for k in range(1, n + 1)]))
    count = F.size(lags)
    return F.aggregate(lags, F.lit(0.0), lambda s, x: s + x) / F.nullif(count, F.lit(0)), count


def exploded_lists(df: DataFrame, keys: list[str], lists: dict[str, str], separator: str = ";") -> DataFrame:
    """keys, side, item: one row for each distinct non-blank item of the separated lists, each list under its side's name."""
    sides = [df.select(*keys, F.lit(side).alias("side"), F.explode(F.split(F.col(c), separator)).alias("item")) for c, side in lists.items()]
    return reduce(lambda a, b: a.unionByName(b), sides).withColumn("item", blank_to_null(F.col("item"))).where("item is not null").distinct()
