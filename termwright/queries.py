"""Registered queries of the engine, one per operator of the blueprint, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from termwright import source_queries
from termwright.definitions import Store
from termwright.functions import predicates as P
from termwright.models import commerce
from termwright.operators import coverage as C
from termwright.plans.gate import Refused
from termwright.plans.run import prepare

Query = Callable[[SparkSession, str], DataFrame]

MODEL = commerce.model()
STORE = Store(MODEL).add(*commerce.DEFINITIONS)

#: The commerce entities in SQL, shared by the twins.
ENTITIES = """
    o AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_orderdate AS orderdate, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders),
    c AS (SELECT c_custkey AS custkey, c_name AS cust_name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer),
    order_ctx AS (SELECT o.*, month = max(month) OVER (PARTITION BY year) AS is_last_month, coalesce(lines, 0) AS lines, coalesce(returned_lines, 0) AS returned_lines, open_quantity, top_discount
        FROM o LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned_lines, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_quantity, max(l_discount) AS top_discount FROM lineitem GROUP BY 1) l ON l_orderkey = orderkey),
    cust_order AS (SELECT *, list_aggregate(r, 'avg') AS recent_price, len(list_filter(r, lambda x: x IS NOT NULL))::BIGINT AS recent_orders FROM (SELECT o.*, cust_name, nationkey, segment,
        lag(orderkey) OVER w AS prev_orderkey, lead(orderkey) OVER w AS next_orderkey, row_number() OVER w AS nth,
        count(CASE WHEN priority = '1-URGENT' THEN 1 END) OVER (PARTITION BY custkey, year ORDER BY orderdate, orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS urgent_before,
        [lag(CASE WHEN price >= 50000 THEN price END, 1 IGNORE NULLS) OVER w, lag(CASE WHEN price >= 50000 THEN price END, 2 IGNORE NULLS) OVER w, lag(CASE WHEN price >= 50000 THEN price END, 3 IGNORE NULLS) OVER w, lag(CASE WHEN price >= 50000 THEN price END, 4 IGNORE NULLS) OVER w] AS r,
        CASE WHEN price >= 1000 THEN price END AS big_price
        FROM o JOIN c USING (custkey) WINDOW w AS (PARTITION BY custkey, year ORDER BY orderdate, orderkey))),
    cust_year AS (SELECT *, orders / avg(orders) OVER (PARTITION BY segment, year) AS order_share FROM (SELECT custkey, year, count(*) AS orders, sum(price) AS spend, max(price) AS top_price, avg(price) AS mean_price, count(DISTINCT month) AS months,
        min(cust_name) AS cust_name, min(segment) AS segment, min(nationkey) AS nationkey, arg_max(priority, (orderdate, orderkey)) AS last_priority, bool_or(status = 'P') AS any_pending FROM o JOIN c USING (custkey) GROUP BY custkey, year)),
    main AS (SELECT l_orderkey AS orderkey, s_nationkey AS seller FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_partkey, l_linenumber) AS rn FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE rn = 1),
    order_side AS (SELECT orderkey, year, month, status, 'buy' AS side, 'sell' AS other_side, nationkey, -price AS amount, -price > 0 AS gained FROM o JOIN c USING (custkey) JOIN main USING (orderkey)
        UNION ALL SELECT orderkey, year, month, status, 'sell', 'buy', seller, price, price > 0 FROM o JOIN c USING (custkey) JOIN main USING (orderkey)),
    nation_year AS (SELECT nationkey, year, count(*) AS orders, sum(price) AS revenue, sum(dw) / nullif(sum(w), 0) AS mean_discount, count(*) FILTER (status = 'F') AS finished, min(n_name) AS nation, min(n_regionkey) AS regionkey
        FROM o JOIN c USING (custkey) LEFT JOIN (SELECT l_orderkey, sum(l_discount * l_extendedprice) AS dw, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1) l ON l_orderkey = orderkey JOIN nation ON n_nationkey = nationkey GROUP BY 1, 2),
    big_spender AS (SELECT custkey, year FROM (SELECT *, cume_dist() OVER (PARTITION BY year ORDER BY spend) AS p FROM cust_year WHERE order_share >= 0.5) WHERE p >= 0.9),
    top_customer AS (SELECT custkey, year FROM (SELECT *, row_number() OVER (PARTITION BY year, nationkey ORDER BY spend DESC, custkey, year) AS p FROM cust_year WHERE order_share >= 0.5) WHERE p <= 1)
"""
JUMP = "(price IS NOT NULL AND recent_price IS NOT NULL AND recent_price > 60000 AND price >= recent_price * 1.5)"
DROP = "(price IS NOT NULL AND recent_price IS NOT NULL AND price - recent_price < -50000)"
PRIOR = "LEFT JOIN cust_year p ON p.custkey = x.custkey AND p.year = x.year - 1"
#: `(keys) IN (set)` behind the prior join: unknown without a prior row.
STAR = "CASE WHEN p.custkey IS NULL THEN NULL ELSE (p.custkey, p.year) IN (SELECT custkey, year FROM big_spender) END"


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Sums of doubles depend on their order; compare them rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def plan(raw: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = prepare(MODEL, STORE, {"limit": 1000, **raw}, commerce.tables(spark, sf_dir))
        if isinstance(got, Refused):
            raise ValueError(f"{got.code}: {got.problems}")
        return rounded(got[0].main)

    return run


def a(attr: str, op: str, value=None) -> dict:
    return {"attr": attr, "op": op} | ({} if value is None else {"value": value})


COUNT = [{"fn": "count", "as": "n"}]
#: name -> (plan, SQL after the entities)
PLANS: dict[str, tuple[dict, str]] = {}


def _rule(name: str, clause: dict, sql: str) -> None:
    PLANS[f"rule_ops_{name}"] = (
        {"entity": "cust_order", "where": [clause], "group_by": ["year"], "metrics": [*COUNT, {"fn": "sum", "of": "price", "as": "total"}]},
        f"SELECT year, count(*) AS n, round(sum(price), 3) AS total FROM cust_order WHERE {sql} GROUP BY 1",
    )


_rule("eq", a("priority", "=", "1-URGENT"), "priority = '1-URGENT'")
_rule("ne", a("segment", "!=", "BUILDING"), "segment <> 'BUILDING'")
_rule("lt", a("price", "<", 50000), "price < 50000")
_rule("le", a("month", "<=", 3), "month <= 3")
_rule("gt", a("price", ">", 150000.0), "price > 150000")
_rule("ge", a("nth", ">=", 2), "nth >= 2")
_rule("in", a("month", "in", [1, 2, 12]), "month IN (1, 2, 12)")
_rule("not_in", a("priority", "not_in", ["1-URGENT", "5-LOW"]), "priority NOT IN ('1-URGENT', '5-LOW')")
_rule("between", a("price", "between", [10000, 90000]), "price BETWEEN 10000 AND 90000")
_rule("is_null", a("recent_price", "is_null"), "recent_price IS NULL")
_rule("is_not_null", a("prev_orderkey", "is_not_null"), "prev_orderkey IS NOT NULL")
_rule("like", a("cust_name", "like", "%1%"), "cust_name LIKE '%1%'")


def _terms(name: str, where: list[dict], sql: str, entity: str = "cust_order", source: str = "cust_order x") -> None:
    PLANS[name] = ({"entity": entity, "where": where, "group_by": ["year"], "metrics": COUNT}, f"SELECT x.year, count(*) AS n FROM {source} WHERE {sql} GROUP BY 1")


CY = "cust_year x"
SHARE = "order_share >= 0.5"
_terms("rule_match_any", [{"term": "odd_order"}], "price < 20000 OR recent_orders = 0")
_terms("clause_not", [{"not": a("priority", "=", "1-URGENT")}, {"not": a("recent_price", ">", 100000)}], "NOT priority = '1-URGENT' AND NOT recent_price > 100000")
_terms("clause_any_all", [{"any_of": [{"all_of": [a("month", "<", 4), a("price", ">", 90000)]}, a("month", "=", 12)]}], "(month < 4 AND price > 90000) OR month = 12")
_terms("percentile_top", [{"term": "big_spender", "basis": "same_season"}], "(custkey, year) IN (SELECT * FROM big_spender)", "cust_year", CY)
_terms("percentile_bottom", [{"term": "low_spender"}], f"(custkey, year) IN (SELECT custkey, year FROM (SELECT *, cume_dist() OVER (PARTITION BY year, segment ORDER BY spend DESC) AS p FROM cust_year WHERE {SHARE}) WHERE p >= 0.75)", "cust_year", CY)
_terms("percentile_tied", [{"term": "busy"}], "(custkey, year) IN (SELECT custkey, year FROM (SELECT *, cume_dist() OVER (PARTITION BY year ORDER BY orders) AS p FROM cust_year WHERE orders >= 1) WHERE p >= 0.5)", "cust_year", CY)
_terms("rank_top", [{"term": "top_customer"}], "(custkey, year) IN (SELECT * FROM top_customer)", "cust_year", CY)
_terms("rank_bottom", [{"term": "smallest"}], f"(custkey, year) IN (SELECT custkey, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY spend, custkey, year) AS p FROM cust_year WHERE {SHARE}) WHERE p <= 10)", "cust_year", CY)
_terms("delta_ratio_min_baseline", [{"term": "price_jump"}], JUMP)
_terms("delta_diff", [{"term": "price_drop"}], DROP)
_terms("delta_not_is_true_on_unknown", [{"not": {"term": "price_drop"}}], f"NOT {DROP}")
_terms("composite_all", [{"term": "notable"}], "x.priority IN ('1-URGENT', '2-HIGH') AND oc.price >= 200000", source="cust_order x LEFT JOIN order_ctx oc USING (orderkey)")
_terms("composite_any", [{"term": "unusual"}], f"{JUMP} OR {DROP}")
_terms("composite_not", [{"term": "not_urgent"}], "NOT priority IN ('1-URGENT', '2-HIGH')")
_terms("composite_lifts_each_term", [{"term": "loyal_notable"}], f"({STAR}) AND x.price >= 200000", source=f"cust_order x {PRIOR}")
_terms("lift_self", [{"term": "has_returns"}], "returned_lines >= 1", "order_ctx", "order_ctx x")
_terms("lift_to_namespace", [{"term": "returned"}], "oc.returned_lines >= 1", source="cust_order x LEFT JOIN order_ctx oc USING (orderkey)")
_terms("lift_current", [{"term": "top_customer"}], "(custkey, year) IN (SELECT * FROM top_customer)")
_terms("lift_prior", [{"term": "big_spender"}], STAR, source=f"cust_order x {PRIOR}")
_terms("basis_override", [{"term": "one_off", "basis": "prior_season"}], "p.orders = 1", source=f"cust_order x {PRIOR}")
_terms("not_prior_membership", [{"not": {"term": "big_spender"}}], f"NOT ({STAR})", source=f"cust_order x {PRIOR}")

PLANS |= {
    "metric_all": (
        {"entity": "cust_order", "metrics": [{"fn": "count"}, {"fn": "count_distinct", "of": "custkey"}, {"fn": "sum", "of": "price"}, {"fn": "avg", "of": "recent_price"}, {"fn": "min", "of": "price"}, {"fn": "max", "of": "orderkey"}]},
        "SELECT count(*) AS count, count(DISTINCT custkey) AS count_distinct_custkey, round(sum(price), 3) AS sum_price, round(avg(recent_price), 3) AS avg_recent_price, min(price) AS min_price, max(orderkey) AS max_orderkey FROM cust_order",
    ),
    "metric_avg_term": ({"entity": "cust_order", "group_by": ["year"], "metrics": [{"fn": "avg", "of": {"term": "big_spender"}, "as": "rate"}, *COUNT]}, f"SELECT x.year, round(avg(CASE WHEN ({STAR}) THEN 1.0::DOUBLE WHEN NOT ({STAR}) THEN 0.0::DOUBLE END), 3) AS rate, count(*) AS n FROM cust_order x {PRIOR} GROUP BY 1"),
    "metric_count_distinct_term": ({"entity": "order_ctx", "group_by": ["status"], "metrics": [{"fn": "count_distinct", "of": {"term": "last_month"}, "as": "ever"}]}, "SELECT status, count(DISTINCT CASE WHEN is_last_month THEN 1 END) AS ever FROM order_ctx GROUP BY 1"),
    "group_by_attr": ({"entity": "cust_order", "group_by": ["segment", "status"], "metrics": COUNT}, "SELECT segment, status, count(*) AS n FROM cust_order GROUP BY 1, 2"),
    "group_by_term_null_group": ({"entity": "cust_order", "group_by": ["year", {"term": "big_spender"}], "metrics": COUNT}, f"SELECT x.year, {STAR} AS big_spender, count(*) AS n FROM cust_order x {PRIOR} GROUP BY 1, 2"),
    "ns_join_prior": ({"entity": "cust_year", "group_by": ["segment"], "metrics": [{"fn": "avg", "of": "prior.spend", "as": "before"}, {"fn": "avg", "of": "spend", "as": "now"}]}, "SELECT x.segment, round(avg(p.spend), 3) AS before, round(avg(x.spend), 3) AS now FROM cust_year x LEFT JOIN cust_year p ON p.custkey = x.custkey AND p.year = x.year - 1 GROUP BY 1"),
    "ns_join_next_season": ({"entity": "cust_year", "where": [a("next.orders", "is_null")], "group_by": ["year"], "metrics": COUNT}, "SELECT x.year, count(*) AS n FROM cust_year x LEFT JOIN cust_year p ON p.custkey = x.custkey AND p.year = x.year + 1 WHERE p.orders IS NULL GROUP BY 1"),
    "ns_join_next_prev": ({"entity": "cust_order", "where": [a("next.price", ">", 100000), a("prev.price", "<", 200000)], "group_by": ["year"], "metrics": [*COUNT, {"fn": "max", "of": "next.price", "as": "top"}]}, "SELECT x.year, count(*) AS n, max(b.price) AS top FROM cust_order x LEFT JOIN cust_order b ON b.custkey = x.custkey AND b.orderkey = x.next_orderkey LEFT JOIN cust_order v ON v.custkey = x.custkey AND v.orderkey = x.prev_orderkey WHERE b.price > 100000 AND v.price < 200000 GROUP BY 1"),
    "ns_join_opp": ({"entity": "order_side", "where": [{"term": "seller"}, a("opp.nationkey", "<", 5)], "group_by": ["nationkey"], "metrics": [*COUNT, {"fn": "avg", "of": "opp.amount", "as": "paid"}]}, "SELECT x.nationkey, count(*) AS n, round(avg(p.amount), 3) AS paid FROM order_side x LEFT JOIN order_side p ON p.orderkey = x.orderkey AND p.side = x.other_side WHERE x.side = 'sell' AND p.nationkey < 5 GROUP BY 1"),
    "game_types_filter": ({"entity": "order_ctx", "game_types": ["F"], "group_by": ["year"], "metrics": COUNT}, "SELECT year, count(*) AS n FROM order_ctx WHERE status IN ('F') GROUP BY 1"),
    "game_types_off": ({"entity": "order_ctx", "game_types": ["*"], "metrics": COUNT}, "SELECT count(*) AS n FROM order_ctx"),
    "season_window": ({"entity": "order_ctx", "seasons": [1996, 1998], "group_by": ["year"], "metrics": COUNT}, "SELECT year, count(*) AS n FROM order_ctx WHERE year BETWEEN 1996 AND 1998 GROUP BY 1"),
    "order_limit_topk": ({"entity": "cust_order", "group_by": ["custkey"], "metrics": [{"fn": "sum", "of": "price", "as": "total"}], "order_by": [{"by": "total", "dir": "desc"}, "custkey"], "limit": 20}, "SELECT custkey, round(sum(price), 3) AS total FROM cust_order GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 20"),
}


def spec_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: orders of customers in the top decile of spend the year before, by year."""
    return plan(PLANS["lift_prior"][0])(spark, sf_dir)


def recent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(commerce.cust_order(spark, sf_dir).select("custkey", "orderkey", "recent_price", "recent_orders"))


def running_count_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.cust_order(spark, sf_dir).select("orderkey", "nth", "urgent_before", "prev_orderkey", "next_orderkey")


def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per customer: its largest order."""
    w = Window.partitionBy("custkey").orderBy(F.desc("price"), "orderkey")
    return commerce.orders(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("custkey", "orderkey", "price")


def mode_any_maxby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent priority (ties: smallest), latest priority and a flag per customer and year."""
    o = commerce.orders(spark, sf_dir)
    w = Window.partitionBy("custkey", "year").orderBy(F.desc("k"), "priority")
    mode = o.groupBy("custkey", "year", "priority").agg(F.count(F.lit(1)).alias("k")).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return mode.select("custkey", "year", F.col("priority").alias("mode_priority")).join(commerce.cust_year(spark, sf_dir).select("custkey", "year", "last_priority", "any_pending"), ["custkey", "year"])


def range_contract_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract in force: an order covers its year and as many more as its priority digit says; the latest wins, then the dearest. Exploded years make the range an equi-join key."""
    o = commerce.orders(spark, sf_dir).withColumn("years", F.substring("priority", 1, 1).cast("int"))
    spread = o.withColumn("season", F.explode(F.sequence(F.col("year"), F.col("year") + F.col("years") - 1)))
    w = Window.partitionBy("custkey", "season").orderBy(F.desc("year"), F.desc_nulls_last("price"), "orderkey")
    return spread.where(F.col("season") <= 2001).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("custkey", "season", "orderkey", "price")


def exists_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the customer orders urgently in any of the next three months: the three months are exploded and joined, no correlated subquery."""
    o = commerce.orders(spark, sf_dir).select("custkey", "orderkey", (F.col("year") * 12 + F.col("month")).alias("m"), "priority")
    urgent = o.where("priority = '1-URGENT'").select("custkey", F.col("m").alias("ahead")).distinct()
    hit = o.withColumn("ahead", F.explode(F.array(*[F.col("m") + i for i in (1, 2, 3)]))).join(urgent, ["custkey", "ahead"]).select("orderkey", F.lit(True).alias("hit")).distinct()
    return o.join(hit, "orderkey", "left").select("orderkey", F.coalesce("hit", F.lit(False)).alias("urgent_soon"))


def anti_xwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id map with a fallback: customers with orders, then all others marked."""
    o, c = commerce.orders(spark, sf_dir), commerce.customers(spark, sf_dir)
    base = o.groupBy("custkey").agg(F.max("orderkey").alias("last_order"))
    rest = c.join(base, "custkey", "left_anti").select("custkey", F.lit(None).cast("long").alias("last_order"))
    return base.unionByName(rest)


def union_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.order_side(spark, sf_dir).groupBy("nationkey", "side").agg(F.round(F.sum("amount"), 3).alias("amount"), F.count(F.lit(1)).alias("n"))


def split_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text to rows, with a dense index and the number of parts."""
    e = commerce.raw(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", r'[{}" ]', "").alias("p"))
    parts = e.select("event_id", F.explode(F.split("p", ",")).alias("part")).distinct()
    w = Window.partitionBy("event_id").orderBy("part")
    return parts.select("event_id", "part", F.row_number().over(w).cast("long").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("event_id")).alias("parts"))


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.nation_year(spark, sf_dir).select("nation", "year", "orders", "finished", F.round("mean_discount", 6).alias("mean_discount"), F.round("revenue", 3).alias("revenue"))


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.orders(spark, sf_dir).withColumn("final", F.col("status") != "O")


def season_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.season_status(_games(spark, sf_dir), "year", "month", "final", commerce.FLOOR)


FACTS = ["price", "recent_price", "prev_orderkey", "big_price", "segment"]


def coverage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = commerce.cust_order(spark, sf_dir).withColumn("late", F.when(F.col("year") >= 1998, F.col("price"))).withColumn("gappy", F.when(F.col("year") != 1999, 1))
    return C.column_coverage(t, "year", [*FACTS, "late", "gappy"], commerce.FLOOR - 1)


def coverage_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_seasons(commerce.orders(spark, sf_dir), "year", "month")


def normalize_blank_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = commerce.raw(spark, sf_dir, "part")
    return p.select("p_partkey", P.blank_to_null(F.regexp_replace("p_type", "^S[A-Z]* ?", " ")).alias("kind"), F.try_element_at(F.split("p_brand", "#"), F.lit(2)).cast("int").alias("brand_no"))


def schema_drift_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append by name: a column that a later load lacks is null, a new one is added."""
    o = commerce.orders(spark, sf_dir)
    old, new = o.where("year < 1998").select("orderkey", "year", "price"), o.where("year >= 1998").select("orderkey", "year", "priority")
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy("year").agg(F.count("price").alias("prices"), F.count("priority").alias("priorities"), F.count(F.lit(1)).alias("n"))


#: Priority codes to a group; an unknown code stays itself in one column and is null in the other.
PRIORITY_GROUP = {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = commerce.orders(spark, sf_dir)
    return o.groupBy(P.code_map(F.col("priority"), PRIORITY_GROUP, True).alias("kept"), P.code_map(F.col("priority"), PRIORITY_GROUP, False).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def raw_sql_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termwright.sqlguard import run_sql

    views = {"orders": commerce.raw(spark, sf_dir, "orders"), "customer": commerce.raw(spark, sf_dir, "customer")}
    return run_sql(spark, "select c_mktsegment as segment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1 -- by segment", views, 100)


OTHERS: dict[str, tuple[Query, str]] = {
    "lag_ignore_nulls_recent_mean": (recent_mean, "SELECT custkey, orderkey, round(recent_price, 3) AS recent_price, recent_orders FROM cust_order"),
    "running_count_prefix": (running_count_prefix, "SELECT orderkey, nth, urgent_before, prev_orderkey, next_orderkey FROM cust_order"),
    "distinct_on": (distinct_on, "SELECT DISTINCT ON (custkey) custkey, orderkey, price FROM o ORDER BY custkey, price DESC, orderkey"),
    "mode_any_maxby": (mode_any_maxby, "SELECT custkey, year, priority AS mode_priority, last_priority, any_pending FROM (SELECT custkey, year, priority, row_number() OVER (PARTITION BY custkey, year ORDER BY count(*) DESC, priority) AS rn FROM o GROUP BY 1, 2, 3) JOIN cust_year USING (custkey, year) WHERE rn = 1"),
    "range_contract_join": (range_contract_join, "SELECT custkey, season, orderkey, price FROM (SELECT o.*, s.season, row_number() OVER (PARTITION BY custkey, s.season ORDER BY year DESC, price DESC, orderkey) AS rn FROM o JOIN (SELECT unnest(range(1995, 2002))::INT AS season) s ON year <= season AND season < year + left(priority, 1)::INT) WHERE rn = 1"),
    "exists_lookahead": (exists_lookahead, "SELECT orderkey, EXISTS (SELECT 1 FROM o u WHERE u.custkey = o.custkey AND u.priority = '1-URGENT' AND u.year * 12 + u.month IN (o.year * 12 + o.month + 1, o.year * 12 + o.month + 2, o.year * 12 + o.month + 3)) AS urgent_soon FROM o"),
    "anti_xwalk": (anti_xwalk, "SELECT custkey, max(orderkey) AS last_order FROM o GROUP BY 1 UNION ALL SELECT custkey, NULL FROM c WHERE custkey NOT IN (SELECT custkey FROM o)"),
    "union_perspectives": (union_perspectives, "SELECT nationkey, side, round(sum(amount), 3) AS amount, count(*) AS n FROM order_side GROUP BY 1, 2"),
    "split_explode": (split_explode, "SELECT event_id, part, row_number() OVER (PARTITION BY event_id ORDER BY part) AS idx, count(*) OVER (PARTITION BY event_id) AS parts FROM (SELECT DISTINCT event_id, unnest(string_split(regexp_replace(props, '[{}\" ]', '', 'g'), ',')) AS part FROM events)"),
    "weighted_mean": (weighted_mean, "SELECT nation, year, orders, finished, round(mean_discount, 6) AS mean_discount, round(revenue, 3) AS revenue FROM nation_year"),
    "season_status": (season_status, "SELECT year, periods, scheduled, final, final = scheduled AS complete, final > 0 AND final <> scheduled AS in_progress, year >= 1996 AND final > 0 AS queryable FROM (SELECT year, count(DISTINCT month) AS periods, count(*) AS scheduled, count(CASE WHEN status <> 'O' THEN 1 END) AS final FROM o GROUP BY 1)"),
    "coverage_columns": (coverage_columns, "SELECT *, coalesce(last_season - first_season + 1 > seasons_with_data, false) AS has_gaps FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS column_name, (min(year) FILTER (x IS NOT NULL))::BIGINT AS first_season, (max(year) FILTER (x IS NOT NULL))::BIGINT AS last_season, count(DISTINCT year) FILTER (x IS NOT NULL) AS seasons_with_data, count(x) AS non_null, count(*) AS total FROM (SELECT year, {e} AS x FROM cust_order WHERE year >= 1995)" for n, e in [*((f, f) for f in FACTS), ("late", "CASE WHEN year >= 1998 THEN price END"), ("gappy", "CASE WHEN year <> 1999 THEN 1 END")]) + ")"),
    "coverage_seasons": (coverage_seasons, 'SELECT year AS season, count(*) AS "rows", min(month)::BIGINT AS first_period, max(month)::BIGINT AS last_period, count(DISTINCT month) AS periods FROM o GROUP BY 1'),
    "normalize_blank_null": (normalize_blank_null, "SELECT p_partkey, nullif(trim(regexp_replace(p_type, '^S[A-Z]* ?', ' ')), '') AS kind, try_cast(nullif(split_part(p_brand, '#', 2), '') AS INT) AS brand_no FROM part"),
    "schema_drift_union": (schema_drift_union, "SELECT year, count(CASE WHEN year < 1998 THEN price END) AS prices, count(CASE WHEN year >= 1998 THEN priority END) AS priorities, count(*) AS n FROM o GROUP BY 1"),
    "code_map": (code_map, "SELECT coalesce(g, priority) AS kept, g AS grp, count(*) AS n FROM (SELECT priority, CASE priority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS g FROM o) GROUP BY 1, 2"),
    "raw_sql_guarded": (raw_sql_guarded, "SELECT segment, count(*) AS n FROM o JOIN c USING (custkey) GROUP BY 1"),
}

OTHERS |= source_queries.QUERIES

QUERIES: dict[str, Query] = {n: plan(p) for n, (p, _) in PLANS.items()} | {n: f for n, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {n: f"WITH {ENTITIES} {sql}" for n, (_, sql) in (PLANS | OTHERS).items()}
