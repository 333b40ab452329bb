"""A build: tables by season in one folder, appended by name, logged, and published by a pointer.

<root>/<build>/<table> is Parquet, in folders by season for a table that is kept season by season, so that replacing a
season rewrites its folder and nothing else. A build is made in <build>.building, renamed when it is whole, and
CURRENT names the one that readers open.
"""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from termwright.sources.normalize import normalize
from termwright.sources.registry import REPLACE, Dataset, Loader, NotPublished, seasons_for

LOG = "dataset string, season int, rows long, seconds double, note string"
LEDGER = "dataset string, season int, column_name string, stored string, incoming string"


def stamp_season(df: DataFrame, season: int | None, column: str = "season") -> DataFrame:
    """The season as a column where the source leaves it out."""
    return df if season is None or column in df.columns else df.withColumn(column, F.lit(season).cast("int"))


def from_floor(df: DataFrame, floor: int, column: str = "season") -> DataFrame:
    """Rows from the floor on; the filter reaches the scan."""
    return df.where(F.col(column) >= floor)


def type_conflicts(stored: T.StructType, incoming: T.StructType) -> list[tuple[str, str, str]]:
    """column, stored type, incoming type, for columns of both that differ."""
    known = {f.name: f.dataType.simpleString() for f in stored}
    return [(f.name, known[f.name], f.dataType.simpleString()) for f in incoming if known.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]


def conform(df: DataFrame, stored: T.StructType) -> DataFrame:
    """Columns that the table has already take its type; what does not fit becomes null."""
    return df.withColumns({name: F.col(f"`{name}`").try_cast(kind) for name, kind, _ in type_conflicts(stored, df.schema)})


def append_by_name(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both by name: a column that one side lacks is null there, and the stored type holds."""
    return stored.unionByName(conform(incoming, stored.schema), allowMissingColumns=True)


def replace_season(stored: DataFrame, incoming: DataFrame, season: int | None, column: str = "season") -> DataFrame:
    """The stored rows but those of the season, and the incoming ones; doing it twice changes nothing."""
    return append_by_name(stored.where(~F.col(column).eqNullSafe(F.lit(season))), incoming)


def upsert_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows in place of those of the same dataset and season; a missing season equals a missing one."""
    key = rows.select(F.col("dataset").alias("d__"), F.col("season").alias("s__")).distinct()
    kept = log.join(key, F.col("dataset").eqNullSafe(F.col("d__")) & F.col("season").eqNullSafe(F.col("s__")), "left_anti")
    return kept.unionByName(rows)


def ledger(conflicts: DataFrame) -> DataFrame:
    """Each distinct conflict once, with its seasons."""
    return conflicts.groupBy("dataset", "column_name", "stored", "incoming").agg(F.count(F.lit(1)).alias("n"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


class Folder:
    """Files of the build folder through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.paths("/".join((self.root, *parts)))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path())) if self.exists() else []

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name):
            self.fs.delete(self.path(name), False)
        self.fs.rename(self.path(f"{name}.new"), self.path(name))

    def read(self, name: str) -> str | None:
        for n in (name, f"{name}.new"):  # a writer stopped between the two steps leaves only the new one
            if self.exists(n):
                size = self.fs.getFileStatus(self.path(n)).getLen()
                source = self.fs.open(self.path(n))
                try:
                    return "".join(chr(source.read()) for _ in range(size))
                finally:
                    source.close()
        return None


@dataclass
class Build:
    """One build in the making."""

    spark: SparkSession
    folder: Folder
    name: str
    floor: int
    log: list[tuple] = field(default_factory=list)
    conflicts: list[tuple] = field(default_factory=list)
    began: float = field(default_factory=time.time)

    def _at(self, table: str) -> str:
        return f"{self.folder.root}/{self.name}.building/{table}"

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(self._at(name)) if self.folder.exists(f"{self.name}.building", name) else None

    def store(self, dataset: Dataset, season: int | None, df: DataFrame) -> None:
        """Creates the table, or replaces one season of it (or all of it)."""
        stored, began = self.table(dataset.name), time.time()
        if stored is not None and dataset.mode != REPLACE:
            for name, old, new in type_conflicts(stored.schema, df.schema):
                if (dataset.name, name, old, new) not in {(c[0], *c[2:]) for c in self.conflicts}:
                    warnings.warn(f"{dataset.name}.{name} is {old}, season {season} has {new}", stacklevel=2)
                self.conflicts.append((dataset.name, season, name, old, new))
            df = conform(df, stored.schema)
        writer = df.write.mode("overwrite")
        if dataset.mode != REPLACE:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(dataset.season)
        writer.parquet(self._at(dataset.name))
        rows = self.table(dataset.name)
        n = (rows if season is None else rows.where(F.col(dataset.season) == season)).count()
        self.log = [r for r in self.log if r[:2] != (dataset.name, season)] + [(dataset.name, season, n, round(time.time() - began, 3), "")]

    def load(self, dataset: Dataset, loader: Loader, current: int, lookback: int = 1, only: tuple[int, int] | None = None) -> None:
        """All seasons of a dataset; what is not published is skipped with a warning, any other failure ends the build."""
        for season in seasons_for(dataset, self.floor, current, lookback, only):
            try:
                df = stamp_season(normalize(loader(dataset, season), dataset.hooks), season, dataset.season)
            except NotPublished as e:
                warnings.warn(f"not published: {e}", stacklevel=2)
                self.log = [r for r in self.log if r[:2] != (dataset.name, season)] + [(dataset.name, season, 0, 0.0, "not published")]
                continue
            self.store(dataset, season, from_floor(df, self.floor, dataset.season) if dataset.season_filter else df)

    def derive(self, builders: list[Derived]) -> list[str]:
        """Derived tables in order; one whose inputs are missing is skipped with a warning. Returns those that were built."""
        done = []
        for d in builders:
            inputs = {n: self.table(n) for n in d.requires}
            if missing := [n for n, t in inputs.items() if t is None]:
                warnings.warn(f"{d.name} is skipped: no {', '.join(missing)}", stacklevel=2)
                continue
            d.build(inputs).write.mode("overwrite").parquet(self._at(d.name))
            done.append(d.name)
        return done

    def publish(self, keep: int = 3, versions: dict[str, str] | None = None) -> str:
        """Writes log, ledger and build info, gives the folder its name, points CURRENT to it and prunes old builds."""
        seasons = [r[1] for r in self.log if r[1] is not None]
        info = {"first_season": min(seasons, default=None), "last_season": max(seasons, default=None), "seconds": round(time.time() - self.began, 3), "spark": self.spark.version, **(versions or {})}
        self.spark.createDataFrame(self.log, LOG).coalesce(1).write.mode("overwrite").parquet(self._at("ingest_log"))
        self.spark.createDataFrame(self.conflicts, LEDGER).coalesce(1).write.mode("overwrite").parquet(self._at("type_ledger"))
        self.spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").parquet(self._at("build_info"))
        name, k = self.name, 1
        while self.folder.exists(name):
            k += 1
            if k > 99:
                raise ValueError(f"{self.name}: no free name")
            name = f"{self.name}-{k}"
        self.folder.fs.rename(self.folder.path(f"{self.name}.building"), self.folder.path(name))
        point(self.folder, name)
        prune(self.folder, keep)
        return name


@dataclass(frozen=True)
class Derived:
    """A table made of others."""

    name: str
    requires: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]


def start(spark: SparkSession, root: str, name: str, floor: int) -> Build:
    """A fresh build; what an earlier one of this name left unfinished goes."""
    folder = Folder(spark, root)
    if folder.exists(f"{name}.building"):
        folder.fs.delete(folder.path(f"{name}.building"), True)
    return Build(spark, folder, name, floor)


def builds(folder: Folder) -> list[str]:
    """Whole builds, the oldest first."""
    whole = [s for s in folder.fs.listStatus(folder.path()) if s.isDirectory() and not s.getPath().getName().endswith(".building")]
    return [s.getPath().getName() for s in sorted(whole, key=lambda s: (s.getModificationTime(), s.getPath().getName()))]


def current(folder: Folder) -> str | None:
    return folder.read("CURRENT")


def point(folder: Folder, name: str) -> None:
    if not folder.exists(name):
        raise ValueError(f"no build {name}")
    folder.write("CURRENT", name)


def rollback(folder: Folder) -> str:
    """Points to the build before the current one."""
    whole, now = builds(folder), current(folder)
    at = whole.index(now) if now in whole else 0
    if at == 0:
        raise ValueError("no earlier build")
    point(folder, whole[at - 1])
    return whole[at - 1]


def prune(folder: Folder, keep: int) -> list[str]:
    """Deletes all but the newest `keep` builds, never the current one."""
    whole, now = builds(folder), current(folder)
    gone = [n for n in whole[: max(0, len(whole) - keep)] if n != now]
    for n in gone:
        folder.fs.delete(folder.path(n), True)
    return gone


def open_current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current build."""
    folder = Folder(spark, root)
    if (name := current(folder)) is None:
        raise ValueError("nothing is published")
    tables = [s.getPath().getName() for s in folder.fs.listStatus(folder.path(name)) if s.isDirectory()]
    return {t: spark.read.option("mergeSchema", True).parquet(f"{folder.root}/{name}/{t}") for t in tables}
