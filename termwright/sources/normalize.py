"""What every loaded table goes through: safe names, blank text as null, common types, and hooks of single datasets."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F, types as T

from termwright.functions.predicates import blank_to_null

#: Types that columns of these names have in every table.
COMMON = {"season": "int", "week": "int", "play_id": "bigint"}


def safe_name(name: str) -> str:
    """Lower case, words joined by one underscore; a name that starts with a digit gets one in front."""
    out = re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "column"
    return f"_{out}" if out[0].isdigit() else out


def safe_columns(df: DataFrame) -> DataFrame:
    """All columns by their safe names; two that would share one are refused."""
    names = [safe_name(c) for c in df.columns]
    if clash := sorted(n for n, k in Counter(names).items() if k > 1):
        raise ValueError(f"columns share a name: {', '.join(f'{n} ({', '.join(c for c, m in zip(df.columns, names) if m == n)})' for n in clash)}")
    return df.toDF(*names)


def strip_text(df: DataFrame) -> DataFrame:
    """Text trimmed in every text column, and blank text as null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: blank_to_null(F.col(f"`{c}`")) for c in texts})


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns that are there, as these types; what does not fit becomes null. Numbers in text may carry a zero fraction."""

    def to(name: str, kind: str):
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, T.StringType) and kind in ("int", "bigint"):
            column = F.regexp_replace(column, r"\.0+$", "")
        return column.try_cast(kind)

    return df.withColumns({c: to(c, k) for c, k in types.items() if c in df.columns and df.schema[c].dataType.simpleString() != k})


def common_casts(df: DataFrame) -> DataFrame:
    return cast_columns(df, COMMON)


def season_from_id(id_col: str, season: str = "season", week: str = "week"):
    """A hook: season and week from an id such as 2023_07_rest, where the table lacks them."""

    def hook(df: DataFrame) -> DataFrame:
        parts = F.split(F.col(f"`{id_col}`"), "_")
        new = {name: F.try_element_at(parts, F.lit(i)).try_cast("int") for i, name in ((1, season), (2, week)) if name not in df.columns}
        return df.withColumns(new)

    return hook


def totals_to_int(*columns: str):
    """A hook: totals that arrive as fractions or text, as whole numbers."""
    return lambda df: cast_columns(df, {c: "int" for c in columns})


def normalize(df: DataFrame, hooks=()) -> DataFrame:
    """Safe names, stripped text, the dataset's hooks, common types."""
    out = strip_text(safe_columns(df))
    for hook in hooks:
        out = hook(out)
    return common_casts(out)
