"""Registry, normalisation, and builds on small tables."""

import warnings

import pytest
from pyspark.sql import functions as F

from termwright.sources import ingest as I, normalize as N
from termwright.sources.registry import Dataset, NotPublished, file_loader, seasons_for


def test_seasons():
    assert seasons_for(Dataset("teams", "replace"), 2020, 2023) == [None]
    assert seasons_for(Dataset("games"), 2020, 2023) == [2020, 2021, 2022, 2023]
    assert seasons_for(Dataset("stats", needs_prior=True), 2020, 2022) == [2019, 2020, 2021, 2022]
    assert seasons_for(Dataset("late", min_season=2022, needs_prior=True), 2020, 2023) == [2022, 2023]
    assert seasons_for(Dataset("games"), 2020, 2023, only=(2021, 2022)) == [2021, 2022]
    assert seasons_for(Dataset("future", min_season=2030), 2020, 2023) == []
    with pytest.raises(ValueError):
        Dataset("x", "sometimes")


def test_safe_columns(spark):
    assert N.safe_columns(spark.createDataFrame([(1, 2, 3)], "`Team.Name` int, ` 1st  Down ` int, Ok int")).columns == ["team_name", "_1st_down", "ok"]
    with pytest.raises(ValueError, match="team_name"):
        N.safe_columns(spark.createDataFrame([(1, 2)], "`Team Name` int, `team-name` int"))


def test_normalize(spark):
    df = spark.createDataFrame([(" a ", "2023", "3.0", "2023_07_x", "12.0"), ("  ", "n/a", None, "odd", "2.5"), (None, "2022", "4", None, None)], "Name string, Season string, Play_ID string, game string, total string")
    got = N.normalize(df, (N.season_from_id("game", "game_season", "game_week"), N.totals_to_int("total")))
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "int", "bigint", "string", "int", "int", "int"]
    assert [tuple(r) for r in got.collect()] == [("a", 2023, 3, "2023_07_x", 12, 2023, 7), (None, None, None, "odd", None, None, None), (None, 2022, 4, None, None, None, None)]
    assert N.normalize(df.limit(0)).count() == 0


def test_append_and_replace(spark):
    stored = spark.createDataFrame([(1, 2020, 1.5), (2, 2021, 2.5)], "id long, season int, v double")
    incoming = spark.createDataFrame([(3, 2021, "7", "new"), (4, 2021, "bad", "new")], "id long, season int, v string, extra string")
    once = I.replace_season(stored, incoming, 2021)
    assert sorted(tuple(r) for r in once.collect()) == [(1, 2020, 1.5, None), (3, 2021, 7.0, "new"), (4, 2021, None, "new")]
    assert sorted(map(tuple, I.replace_season(once, incoming, 2021).collect())) == sorted(map(tuple, once.collect()))
    assert I.type_conflicts(stored.schema, incoming.schema) == [("v", "double", "string")]


def test_log_upsert_treats_a_missing_season_as_one(spark):
    log = spark.createDataFrame([("teams", None, 1, 0.0, ""), ("games", 2020, 5, 0.0, ""), ("games", 2021, 6, 0.0, "")], I.LOG)
    rows = spark.createDataFrame([("teams", None, 9, 0.0, ""), ("games", 2021, 7, 0.0, "")], I.LOG)
    assert sorted((r.dataset, r.season or 0, r.rows) for r in I.upsert_log(log, rows).collect()) == [("games", 2020, 5), ("games", 2021, 7), ("teams", 0, 9)]


@pytest.fixture
def source(spark, tmp_path):
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/up/{name}")
    put("teams", [(" A ",), ("B",)], "Team string")
    put("games/2020", [("g1", "1", 3.0)], "Game string, Week string, points double")
    put("games/2021", [("g2", "2", 4.0, "x")], "Game string, Week string, points double, note string")
    put("games/2022", [("g3", "1", "5")], "Game string, Week string, points string")
    return tmp_path


def test_build_publish_and_rollback(spark, source):
    load, root = file_loader(spark, f"{source}/up"), f"{source}/out"
    teams, games = Dataset("teams", "replace"), Dataset("games")

    def make(last):
        b = I.start(spark, root, "day", 2020)
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            b.load(teams, load, last)
            b.load(games, load, last)
            assert b.derive([I.Derived("weeks", ("games",), lambda t: t["games"].groupBy("week").count()), I.Derived("none", ("nowhere",), lambda t: None)]) == ["weeks"]
        return b.publish(keep=2), [str(w.message) for w in seen]

    name, told = make(2023)
    assert name == "day" and any("not published: games 2023" in t for t in told) and any("games.points is double" in t for t in told) and any("none is skipped" in t for t in told)
    t = I.open_current(spark, root)
    assert sorted((r.game, r.week, r.points, r.note, r.season) for r in t["games"].collect()) == [("g1", 1, 3.0, None, 2020), ("g2", 2, 4.0, "x", 2021), ("g3", 1, 5.0, None, 2022)]
    assert sorted(r.team for r in t["teams"].collect()) == ["A", "B"]
    assert [tuple(r) for r in t["type_ledger"].collect()] == [("games", 2022, "points", "double", "string")]
    assert sorted((r.dataset, r.season, r.rows) for r in t["ingest_log"].where("season is not null").collect()) == [("games", 2020, 1), ("games", 2021, 1), ("games", 2022, 1), ("games", 2023, 0)]
    assert '"first_season": 2020' in t["build_info"].first().info
    second, _ = make(2021)
    folder = I.Folder(spark, root)
    assert second == "day-2" and I.current(folder) == "day-2" and I.open_current(spark, root)["games"].count() == 2
    assert I.rollback(folder) == "day" and I.current(folder) == "day"
    with pytest.raises(ValueError):
        I.rollback(folder)
    third, _ = make(2020)
    assert third == "day-3" and I.current(folder) == "day-3" and I.builds(folder) == ["day-2", "day-3"]


def test_failures_other_than_not_published_end_the_build(spark, source):
    def broken(dataset, season):
        raise OSError("disk")

    b = I.start(spark, f"{source}/other", "x", 2020)
    with pytest.raises(OSError):
        b.load(Dataset("games"), broken, 2020)
    with pytest.raises(NotPublished):
        file_loader(spark, f"{source}/up")(Dataset("games"), 1999)
    with pytest.raises(ValueError):
        I.open_current(spark, f"{source}/other")


def test_a_season_is_replaced_in_place(spark, source):
    b = I.start(spark, f"{source}/again", "x", 2020)
    rows = lambda v: spark.createDataFrame([(1, 2020, v), (2, 2021, v)], "id int, season int, v int")
    b.store(Dataset("t"), None, rows(1))
    b.store(Dataset("t"), 2021, rows(2).where(F.col("season") == 2021))
    b.store(Dataset("t"), 2021, rows(3).where(F.col("season") == 2021))
    assert sorted((r.season, r.v) for r in b.table("t").collect()) == [(2020, 1), (2021, 3)]
