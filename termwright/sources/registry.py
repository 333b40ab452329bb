"""The datasets a build reads, which seasons it asks for, and how loaders fail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

REPLACE, BY_SEASON = "replace", "by_season"


class NotPublished(Exception):
    """The season is not out yet: skipped with a warning, where any other failure ends the build."""


@dataclass(frozen=True)
class Dataset:
    """One upstream table: replaced whole, or season by season."""

    name: str
    mode: str = BY_SEASON
    min_season: int | None = None
    needs_prior: bool = False
    season_filter: bool = False
    season: str = "season"
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    def __post_init__(self):
        if self.mode not in (REPLACE, BY_SEASON):
            raise ValueError(f"{self.name}: unknown mode {self.mode}")


Loader = Callable[[Dataset, int | None], DataFrame]


def seasons_for(dataset: Dataset, floor: int, current: int, lookback: int = 1, only: tuple[int, int] | None = None) -> list[int | None]:
    """Seasons to load, from the floor (less a lookback where prior seasons matter, raised to the dataset's first) to the current one; [None] for a dataset that is replaced whole."""
    if dataset.mode == REPLACE:
        return [None]
    first = floor - (lookback if dataset.needs_prior else 0)
    if dataset.min_season is not None:
        first = max(first, dataset.min_season)
    last = current
    if only is not None:
        first, last = max(first, only[0] - (lookback if dataset.needs_prior else 0)), min(last, only[1])
    return list(range(first, last + 1))


def file_loader(spark: SparkSession, folder: str, kind: str = "parquet") -> Loader:
    """Reads <folder>/<dataset>/<season>, or <folder>/<dataset> for one that is replaced whole; a path that is not there is not published."""

    def load(dataset: Dataset, season: int | None) -> DataFrame:
        path = f"{folder}/{dataset.name}" + ("" if season is None else f"/{season}")
        try:
            reader = spark.read.format(kind)
            return (reader.option("header", True) if kind == "csv" else reader).load(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise NotPublished(f"{dataset.name} {season or ''}".strip()) from None
            raise

    return load
