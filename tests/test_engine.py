"""Signals, gate, store and compiler."""

import random

import pytest

from termwright.definitions import Store
from termwright.model import Entity, Model, attributes
from termwright.models import commerce
from termwright.operators import signals as S
from termwright.operators.coverage import Coverage
from termwright.plans.gate import Passed, Refused, check, coverage_of
from termwright.plans.plan import PlanError, english, parse
from termwright.plans.run import query

MODEL = commerce.model()


@pytest.fixture
def store():
    return Store(MODEL).add(*commerce.DEFINITIONS)


SHOPS = Entity("shops", ("shop", "year"), ("shop",), attributes(all="shop:str year:int sales:float town:str"), season="year")
TOWNS = Model("towns", {"shops": SHOPS}, {}, ("R",), ("R",), ("shops",), lambda *_: {})


@pytest.fixture(scope="module")
def shops():
    """Three towns of unlike size whose sales have few distinct values, with sales and towns missing."""
    rng = random.Random(11)
    rows = [(f"s{i:03}", 2001 + i % 2, rng.choice([None, 2.0, 3.0, 3.0, 5.0, 8.0]), rng.choice([None, "a", "a", "a", "b"])) for i in range(90)]
    return rows + [("only", 2001, 1.0, "c")]


def chosen(spark, rows, **params):
    d = Store(TOWNS).add({"name": "dd", "entity": "shops", "signal": params.pop("signal"), "params": {"attr": "sales", "cohort": ["town", "year"], **params}}).get("dd")
    return {(r["shop"], r["year"]) for r in S.cohort(TOWNS, d, spark.createDataFrame(rows, "shop string, year int, sales double, town string")).collect()}


@pytest.mark.parametrize("direction", ["top", "bottom"])
@pytest.mark.parametrize("pctile", [0, 12, 37.5, 60, 99, 100])
def test_percentiles_by_counting(spark, shops, pctile, direction):
    """In the set: at least the percentile's share of the cohort is no better, counting ties with the row."""
    want = set()
    for shop, year, sales, town in shops:
        if sales is not None and town is not None:
            peers = [s for _, y, s, t in shops if (y, t) == (year, town) and s is not None]
            if direction == "top" and sum(s <= sales for s in peers) / len(peers) >= pctile / 100:
                want.add((shop, year))
            if direction == "bottom" and sum(s >= sales for s in peers) / len(peers) >= (100 - pctile) / 100:
                want.add((shop, year))
    assert chosen(spark, shops, signal="percentile", pctile=pctile, direction=direction) == want


@pytest.mark.parametrize("direction, sign", [("top", -1), ("bottom", 1)])
def test_ranks_by_sorting(spark, shops, direction, sign):
    """Ties at the edge are broken by key."""
    want = set()
    for cohort in {(y, t) for _, y, s, t in shops if t is not None}:
        mine = sorted((sign * s, shop) for shop, y, s, t in shops if (y, t) == cohort and s is not None)
        want |= {(shop, cohort[0]) for _, shop in mine[:4]}
    assert chosen(spark, shops, signal="rank", top_n=4, direction=direction) == want


def test_membership_partitions_rows_in_three(spark, sf_dir, store):
    """in + not in + unknown = all, and unknown is exactly the rows without a prior year."""
    tables = commerce.tables(spark, sf_dir)
    ask = lambda *where: query(spark, MODEL, store, {"entity": "cust_order", "where": list(where), "metrics": [{"fn": "count", "as": "n"}]}, tables)["rows"][0]["n"]
    inside, outside, every = ask({"term": "big_spender"}), ask({"not": {"term": "big_spender"}}), ask()
    unknown = ask({"attr": "prior.custkey", "op": "is_null"})
    assert inside + outside + unknown == every and inside and outside and unknown


def test_delta_is_never_unknown(spark, sf_dir, store):
    tables = commerce.tables(spark, sf_dir)
    ask = lambda c: query(spark, MODEL, store, {"entity": "cust_order", "where": [c]}, tables)["rows"][0]["count"]
    assert ask({"term": "price_jump"}) + ask({"not": {"term": "price_jump"}}) == tables["cust_order"].count()


def test_envelope(spark, sf_dir, store):
    got = query(spark, MODEL, store, {"entity": "cust_order", "where": [{"term": "notable"}], "group_by": ["year"], "question": "why"}, commerce.tables(spark, sf_dir))
    assert got["ok"] and got["matched"] == sum(r["count"] for r in got["rows"])
    assert [d["name"] for d in got["definitions_used"]] == ["urgent", "large_order", "notable"]
    assert len(got["sample"]) <= 10 and got["english"] == "count of cust_order where notable by year"


@pytest.mark.parametrize(
    "plan, code",
    [
        ({"entity": "nope"}, "invalid_plan"),
        ({"entity": "cust_order", "limit": 5000}, "invalid_plan"),
        ({"entity": "cust_order", "sample_rows": 51}, "invalid_plan"),
        ({"entity": "cust_order", "game_types": []}, "invalid_plan"),
        ({"entity": "cust_order", "where": [{"attr": "prise", "op": "=", "value": 1}]}, "unknown_attribute"),
        ({"entity": "cust_order", "where": [{"attr": "price", "op": "=", "value": True}]}, "invalid_plan"),
        ({"entity": "cust_order", "metrics": [{"fn": "sum", "of": "segment"}]}, "invalid_plan"),
        ({"entity": "cust_order", "where": [{"term": "posh"}]}, "unresolved_term"),
        ({"entity": "order_ctx", "where": [{"term": "urgent"}]}, "entity_mismatch"),
        ({"entity": "cust_order", "where": [{"term": "urgent", "basis": "prior_season"}]}, "invalid_plan"),
    ],
)
def test_refusals(store, plan, code):
    got = check(MODEL, store, parse(plan))
    assert isinstance(got, Refused) and got.code == code


def test_unknown_attribute_suggests(store):
    got = check(MODEL, store, parse({"entity": "cust_order", "where": [{"attr": "prise", "op": "=", "value": 1}]}))
    assert "price" in got.problems[0]["did_you_mean"]


@pytest.mark.parametrize(
    "plan", [{"metrics": []}, {"entity": "x", "nope": 1}, {"entity": "x", "where": [{"attr": "a"}]}, {"entity": "x", "where": [{"any_of": []}]}, {"entity": "x", "metrics": [{"fn": "sum"}]}, {"entity": "x", "metrics": [{"fn": "sum", "of": {"term": "t"}}]}, {"entity": "x", "metrics": [{"fn": "count"}, {"fn": "count"}]}]
)
def test_bad_shapes(plan):
    with pytest.raises(PlanError):
        parse(plan)


def fact(first, last, non_null=1):
    return {"first_season": first, "last_season": last, "non_null": non_null, "total": 9, "has_gaps": False, "seasons_with_data": 1}


def coverage():
    status = {y: {"year": y, "complete": y < 2001, "in_progress": y == 2001, "queryable": y >= 1996} for y in range(1995, 2002)}
    cols = {("cust_order", n): fact(1995, 2001) for n in ("price", "priority", "year")} | {("cust_order", "recent_price"): fact(1998, 2001), ("cust_order", "big_price"): fact(None, None, 0)}
    cols |= {("cust_year", n): fact(1995, 2001) for n in ("spend", "year", "order_share", "custkey")} | {("cust_year", "mean_price"): fact(1997, 2001)}
    return Coverage(cols, status)


def gated(store, **plan):
    return check(MODEL, store, parse({"entity": "cust_order", **plan}), coverage())


def test_seasons_default_to_what_is_queryable(store):
    got = gated(store, where=[{"attr": "price", "op": ">", "value": 1}])
    assert isinstance(got, Passed) and got.seasons == (1996, 2001) and "in progress" in got.warnings[0]


def test_a_lagged_column_starts_a_season_later(store):
    got = gated(store, where=[{"attr": "prior.mean_price", "op": ">", "value": 1}])
    assert got.seasons == (1998, 2001) and got.excluded == [1996, 1997]


def test_partial_coverage_is_refused_or_clamped(store):
    ask = {"where": [{"attr": "recent_price", "op": ">", "value": 1}], "seasons": [1996, 1999]}
    assert gated(store, **ask).code == "coverage_gap"
    got = gated(store, **ask, allow_partial_coverage=True)
    assert got.seasons == (1998, 1999) and got.excluded == [1996, 1997]


def test_never_populated_column_is_a_gap(store):
    assert gated(store, where=[{"attr": "big_price", "op": ">", "value": 1}]).code == "coverage_gap"


def test_intersections():
    c = coverage()
    assert c.intersect([("cust_order", "price")]) == (1996, 2001) and c.intersect([]) == (1996, 2001)
    assert c.intersect([("cust_order", "nope")]) is None and c.intersect([("cust_order", "big_price")]) is None
    assert c.latest_complete() == 2000


def test_broken_definitions_are_quarantined_with_what_rests_on_them():
    s = Store(MODEL).add(
        {"name": "bad", "entity": "cust_order", "signal": "rule", "params": {"rules": [{"attr": "nope", "op": "=", "value": 1}]}},
        {"name": "above", "entity": "cust_order", "signal": "composite", "params": {"op": "not", "terms": ["bad"]}},
        {"name": "loop", "entity": "cust_order", "signal": "composite", "params": {"op": "not", "terms": ["loop"]}},
    )
    assert set(s.broken) == {"bad", "above", "loop"} and not s.known
    assert check(MODEL, s, parse({"entity": "cust_order", "where": [{"term": "bad"}]})).code == "definition_broken"


def test_what_is_quarantined_stays_so_until_it_holds():
    s = Store(MODEL).add({"name": "above", "entity": "cust_order", "signal": "composite", "params": {"op": "not", "terms": ["base"]}})
    assert set(s.broken) == {"above"}
    s.save({"name": "other", "entity": "cust_order", "signal": "rule", "params": {"rules": [{"attr": "price", "op": ">", "value": 1.0}]}})
    assert set(s.broken) == {"above"} and check(MODEL, s, parse({"entity": "cust_order", "where": [{"term": "above"}]})).code == "definition_broken"
    s.save({"name": "base", "aliases": ["ground"], "entity": "cust_order", "signal": "rule", "params": {"rules": [{"attr": "price", "op": ">", "value": 2.0}]}})
    assert not s.broken and s.get("above")
    s.delete("ground")
    assert s.get("base") is None and set(s.broken) == {"above"}
    with pytest.raises(ValueError):
        s.delete("ground")


def test_added_definitions_are_validated_beside_a_folder(tmp_path):
    s = Store(MODEL, tmp_path).load().add({"name": "bad", "entity": "cust_order", "signal": "rule", "params": {"rules": [{"attr": "nope", "op": "=", "value": 1}]}})
    assert set(s.broken) == {"bad"} and s.get("bad") is None


def test_the_gate_says_what_limits_the_seasons(store):
    got = gated(store, where=[{"attr": "prior.mean_price", "op": ">", "value": 1}], seasons=[1996, 1999])
    assert got.code == "coverage_gap"
    told = got.problems[0]
    assert told["limiting"][0]["lag"] == 1 and "read 1 season back" in told["why"] and told["excluded"] == [1996, 1997]
    assert coverage_of(MODEL, store, "price_jump", coverage()) and coverage_of(MODEL, store, "nobody", coverage()) is None


def test_order_by_a_grouped_attribute(spark, sf_dir, store):
    plan = {"entity": "cust_order", "group_by": ["prior.segment"], "metrics": [{"fn": "count", "as": "n"}], "order_by": [{"by": "prior.segment", "dir": "desc"}]}
    parts = [next(v for k, v in r.items() if k != "n") for r in query(spark, MODEL, store, plan, commerce.tables(spark, sf_dir))["rows"]]
    known = [x for x in parts if x is not None]
    assert len(known) > 2 and known == sorted(known, reverse=True)
    assert gated(store, order_by=[{"key": "segment"}]).code == "invalid_plan"


def test_store_round_trip(tmp_path):
    s = Store(MODEL, tmp_path)
    d = {"name": "cheap", "aliases": ["low_price"], "entity": "cust_order", "signal": "rule", "params": {"rules": [{"attr": "price", "op": "<", "value": 10.0}]}}
    assert s.save(d).version == 1
    with pytest.raises(ValueError):
        s.save(d)
    assert s.save(d, overwrite=True).version == 2 and list((tmp_path / ".history").iterdir())
    with pytest.raises(ValueError):
        s.save({**d, "name": "other"})
    again = Store(MODEL, tmp_path).load()
    assert again.get("low_price").version == 2
    (tmp_path / "wrong.json").write_text("{")
    again.refresh()
    assert "wrong" in again.broken and again.get("cheap")
    assert Store(MODEL).take(again.export())["added"] == ["cheap"]
    again.delete("cheap")
    assert again.get("cheap") is None


def test_propose_offers_near_names_and_candidates(store):
    assert "big_spender" in store.propose("big spenders")["near"]
    got = store.propose("spend")
    assert any(c["params"]["attr"] == "spend" for c in got["candidates"]) and not got["not_computable"]
    assert store.propose("zzz")["not_computable"]


def test_english():
    assert english(parse({"entity": "x", "where": [{"not": {"term": "very_big"}}, {"any_of": [{"attr": "a", "op": "is_null"}, {"attr": "b", "op": ">", "value": 2}]}]})) == "count of x where not (very big) and (a is null or b > 2)"
