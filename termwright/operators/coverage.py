"""Which seasons each column can answer, computed from the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

#: Columns of one aggregate: very wide tables would make one huge generated class.
CHUNK = 100


def season_status(games: DataFrame, season: str, period: str, final: str, floor: int) -> DataFrame:
    """One row per season: periods, scheduled and final rows, complete, in_progress, queryable."""
    by = games.groupBy(season).agg(
        F.countDistinct(period).cast("long").alias("periods"),
        F.count(F.lit(1)).alias("scheduled"),
        F.count(F.when(F.col(final), 1)).alias("final"),
    )
    done = F.col("final") == F.col("scheduled")
    return by.withColumns({"complete": done, "in_progress": (F.col("final") > 0) & ~done, "queryable": (F.col(season) >= floor) & (F.col("final") > 0)})


def team_season_status(games: DataFrame, season: str, period: str, final: str, teams: list[str], playoff: str, floor: int) -> DataFrame:
    """season_status with games_per_team (the most regular games any team has) and playoff_teams; a season without playoffs has none.

    games has a column for each team of a game; `playoff` and `final` are boolean columns. periods are regular ones.
    """
    sides = None
    for team in teams:
        one = games.select(season, F.col(team).alias("team__"), F.col(playoff).alias("playoff__"))
        sides = one if sides is None else sides.unionByName(one)
    per_team = sides.where("team__ is not null").groupBy(season, "team__").agg(F.count(F.when(~F.col("playoff__"), 1)).alias("regular__"), F.max(F.col("playoff__").cast("int")).alias("in__"))
    wide = per_team.groupBy(season).agg(F.max("regular__").alias("games_per_team"), F.sum("in__").cast("long").alias("playoff_teams"))
    by = games.groupBy(season).agg(F.countDistinct(F.when(~F.col(playoff), F.col(period))).cast("long").alias("periods"), F.count(F.lit(1)).alias("scheduled"), F.count(F.when(F.col(final), 1)).alias("final"))
    done = F.col("final") == F.col("scheduled")
    out = by.join(wide, season, "left").withColumns({"games_per_team": F.coalesce("games_per_team", F.lit(0)), "playoff_teams": F.coalesce("playoff_teams", F.lit(0))})
    return out.withColumns({"complete": done, "in_progress": (F.col("final") > 0) & ~done, "queryable": (F.col(season) >= floor) & (F.col("final") > 0)})


def column_facts(table: DataFrame, season: str | None, columns: list[str]) -> DataFrame:
    """column_name, season, non_null, total: one scan for each hundred columns, unpivoted."""
    out = None
    for at in range(0, len(columns), CHUNK):
        some = columns[at : at + CHUNK]
        by = table.groupBy(F.col(season).alias("season")) if season else table.groupBy()
        wide = by.agg(F.count(F.lit(1)).alias("total__"), *[F.count(F.col(c)).alias(c) for c in some])
        if not season:
            wide = wide.withColumn("season", F.lit(None).cast("int"))
        tall = wide.unpivot(["season", "total__"], some, "column_name", "non_null").withColumnRenamed("total__", "total")
        out = tall if out is None else out.unionByName(tall)
    return out


def column_coverage(table: DataFrame, season: str | None, columns: list[str], floor: int) -> DataFrame:
    """column_name, first_season, last_season, seasons_with_data, has_gaps, non_null, total from the floor on; a table without seasons has none and no gaps."""
    seen = column_facts(table.where(F.col(season) >= floor) if season else table, season, columns)
    has = F.when(F.col("non_null") > 0, F.col("season"))
    g = seen.groupBy("column_name").agg(
        F.min(has).cast("long").alias("first_season"), F.max(has).cast("long").alias("last_season"), F.count(has).alias("seasons_with_data"), F.sum("non_null").alias("non_null"), F.sum("total").alias("total")
    )
    return g.withColumn("has_gaps", F.coalesce(F.col("last_season") - F.col("first_season") + 1 > F.col("seasons_with_data"), F.lit(False)))


def table_seasons(table: DataFrame, season: str, period: str) -> DataFrame:
    return table.groupBy(F.col(season).alias("season")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(period).cast("long").alias("first_period"), F.max(period).cast("long").alias("last_period"), F.countDistinct(period).alias("periods")
    )


@dataclass
class Coverage:
    """The registry on the driver: a few hundred facts."""

    columns: dict[tuple[str, str], dict] = field(default_factory=dict)
    seasons: dict[int, dict] = field(default_factory=dict)

    def queryable(self) -> list[int]:
        return sorted(s for s, r in self.seasons.items() if r["queryable"])

    def latest_complete(self) -> int | None:
        return max((s for s, r in self.seasons.items() if r["complete"]), default=None)

    def intersect(self, refs: list[tuple[str, str]]) -> tuple[int, int] | None:
        """Seasons all columns can answer, within the queryable ones; None for an unknown or empty column."""
        q = self.queryable()
        if not q:
            return None
        lo, hi = q[0], q[-1]
        for r in refs:
            c = self.columns.get(r)
            if c is None or not c["non_null"]:
                return None
            if c["first_season"] is not None:
                lo, hi = max(lo, c["first_season"]), min(hi, c["last_season"])
        return (lo, hi) if lo <= hi else None

    @staticmethod
    def of(status: DataFrame, season: str, tables: dict[str, tuple[DataFrame, str | None, list[str]]], floor: int) -> Coverage:
        out = Coverage(seasons={r[season]: r.asDict() for r in status.collect()})
        for name, (table, its, columns) in tables.items():
            for r in column_coverage(table, its, columns, floor).collect():
                out.columns[(name, r["column_name"])] = r.asDict()
        return out
