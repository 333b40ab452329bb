"""The commerce domain over the driver's star schema: feature builders, entities, lifts and shipped definitions.

Season is the order year, period the month, game type the order status. Every builder is joins, windows
and aggregates of built-in functions; dimension tables of fixed size are the only broadcast sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from termwright.functions.predicates import ratio
from termwright.model import Entity, Join, Model, attributes

FLOOR = 1996


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.col("o_orderdate").alias("orderdate"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )


def order_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its lines counted by kind (filtered aggregates) and a flag for its year's last month."""
    lines = raw(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned_lines"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_quantity"), F.max("l_discount").alias("top_discount"),
    )
    o = orders(spark, sf_dir)
    last = o.groupBy("year").agg(F.max("month").alias("last_month"))
    return (
        o.join(lines, o.orderkey == lines.l_orderkey, "left").drop("l_orderkey").join(F.broadcast(last), "year")
        .withColumns({"is_last_month": F.col("month") == F.col("last_month"), "lines": F.coalesce("lines", F.lit(0)), "returned_lines": F.coalesce("returned_lines", F.lit(0))})
        .drop("last_month")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("cust_name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))


def cust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order of a customer: neighbours within the year and the mean price of the last four priced orders."""
    w = Window.partitionBy("custkey", "year").orderBy("orderdate", "orderkey")
    o = orders(spark, sf_dir).join(customers(spark, sf_dir), "custkey")
    big = F.when(F.col("price") >= 1000, F.col("price"))
    recent = [F.expr(f"lag(CASE WHEN price >= 50000 THEN price END, {k}) IGNORE NULLS OVER (PARTITION BY custkey, year ORDER BY orderdate, orderkey)") for k in range(1, 5)]
    found = F.array_compact(F.array(*recent))
    return o.withColumns(
        {
            "prev_orderkey": F.lag("orderkey").over(w), "next_orderkey": F.lead("orderkey").over(w), "nth": F.row_number().over(w).cast("long"),
            "urgent_before": F.count(F.when(F.col("priority") == "1-URGENT", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "recent_price": F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(found), F.lit(0)), "recent_orders": F.size(found).cast("long"), "big_price": big,
        }
    )


def cust_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and year; order_share is its orders against its segment's mean, the default eligibility."""
    o = orders(spark, sf_dir).join(customers(spark, sf_dir), "custkey")
    g = o.groupBy("custkey", "year").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("price").alias("spend"), F.max("price").alias("top_price"), F.avg("price").alias("mean_price"), F.countDistinct("month").alias("months"),
        F.min("cust_name").alias("cust_name"), F.min("segment").alias("segment"), F.min("nationkey").alias("nationkey"), F.max_by("priority", F.struct("orderdate", "orderkey")).alias("last_priority"), F.bool_or(F.col("status") == "P").alias("any_pending"),
    )
    return g.withColumn("order_share", ratio(F.col("orders").cast("double"), F.avg("orders").over(Window.partitionBy("segment", "year"))))


def order_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per order, the buyer's nation and the main supplier's, with the amount's sign flipped."""
    first = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_partkey", "l_linenumber")
    main = raw(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    sup = raw(spark, sf_dir, "supplier")
    main = main.join(sup, main.l_suppkey == sup.s_suppkey).select(F.col("l_orderkey").alias("orderkey"), F.col("s_nationkey").alias("seller"))
    o = orders(spark, sf_dir).join(customers(spark, sf_dir).select("custkey", F.col("nationkey").alias("buyer")), "custkey").join(main, "orderkey")
    cols = ["orderkey", "year", "month", "status"]
    buy = o.select(*cols, F.lit("buy").alias("side"), F.lit("sell").alias("other_side"), F.col("buyer").alias("nationkey"), (-F.col("price")).alias("amount"))
    sell = o.select(*cols, F.lit("sell").alias("side"), F.lit("buy").alias("other_side"), F.col("seller").alias("nationkey"), F.col("price").alias("amount"))
    return buy.unionByName(sell).withColumn("gained", F.col("amount") > 0)


def nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation and year: totals and the discount weighted by price."""
    l = raw(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_discount") * F.col("l_extendedprice")).alias("dw"), F.sum("l_extendedprice").alias("w"))
    o = orders(spark, sf_dir).join(customers(spark, sf_dir), "custkey")
    n = raw(spark, sf_dir, "nation").dropDuplicates(["n_nationkey"]).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("regionkey"))
    g = o.join(l, o.orderkey == l.l_orderkey, "left").groupBy("nationkey", "year").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("price").alias("revenue"), ratio(F.sum("dw"), F.sum("w")).alias("mean_discount"), F.count(F.when(F.col("status") == "F", 1)).alias("finished")
    )
    return g.join(F.broadcast(n), "nationkey")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The entity tables, lazily."""
    return {f.__name__: f(spark, sf_dir) for f in (order_ctx, cust_order, cust_year, order_side, nation_year)}


def model() -> Model:
    time = "year:int month:int status:str"
    entities = [
        Entity("order_ctx", ("orderkey",), ("orderkey",), attributes(time=time, size="price:float lines:int open_quantity:float", money="top_discount:float", returns="returned_lines:int is_last_month:bool", who="orderkey:int custkey:int priority:str"), season="year", order=("month",), kind="status"),
        Entity(
            "cust_order", ("custkey", "orderkey"), ("cust_name", "month"),
            attributes(time=time, money="price:float recent_price:float big_price:float", who="custkey:int orderkey:int cust_name:str nationkey:int segment:str priority:str", links="prev_orderkey:int next_orderkey:int", counts="nth:int urgent_before:int recent_orders:int"),
            {
                "order": Join("order_ctx", (("orderkey", "orderkey"),)),
                "cur": Join("cust_year", (("custkey", "custkey"), ("year", "year"))),
                "prior": Join("cust_year", (("custkey", "custkey"), ("year", "year")), 1),
                "nation_year": Join("nation_year", (("nationkey", "nationkey"), ("year", "year"))),
                "next": Join("cust_order", (("custkey", "custkey"), ("next_orderkey", "orderkey"))),
                "prev": Join("cust_order", (("custkey", "custkey"), ("prev_orderkey", "orderkey"))),
            },
            "year", ("month",), "status",
        ),
        Entity(
            "cust_year", ("custkey", "year"), ("cust_name",),
            attributes(time="year:int", money="spend:float top_price:float mean_price:float", counts="orders:int months:int order_share:float", who="custkey:int cust_name:str segment:str nationkey:int last_priority:str", flags="any_pending:bool"),
            {"prior": Join("cust_year", (("custkey", "custkey"), ("year", "year")), 1), "next": Join("cust_year", (("custkey", "custkey"), ("year", "year")), -1), "nation_year": Join("nation_year", (("nationkey", "nationkey"), ("year", "year")))},
            "year", (), None, ({"attr": "order_share", "op": ">=", "value": 0.5},),
        ),
        Entity(
            "order_side", ("orderkey", "side"), ("side",), attributes(time=time, who="orderkey:int side:str other_side:str nationkey:int", money="amount:float gained:bool"),
            {"order": Join("order_ctx", (("orderkey", "orderkey"),)), "opp": Join("order_side", (("orderkey", "orderkey"), ("other_side", "side"))), "nation_year": Join("nation_year", (("nationkey", "nationkey"), ("year", "year")))},
            "year", ("month",), "status",
        ),
        Entity("nation_year", ("nationkey", "year"), ("nation",), attributes(time="year:int", who="nationkey:int nation:str regionkey:int", money="revenue:float mean_discount:float", counts="orders:int finished:int"), {"prior": Join("nation_year", (("nationkey", "nationkey"), ("year", "year")), 1)}, "year"),
    ]
    lifts = {
        ("order_ctx", "cust_order"): {"": "order"}, ("order_ctx", "order_side"): {"": "order"},
        ("cust_year", "cust_order"): {"": "cur", "prior": "prior"},
        ("nation_year", "cust_order"): {"": "nation_year"}, ("nation_year", "cust_year"): {"": "nation_year"}, ("nation_year", "order_side"): {"": "nation_year"},
    }
    return Model("commerce", {e.name: e for e in entities}, lifts, ("F", "O", "P"), ("F", "O", "P"), ("cust_year",), tables)


def _rule(name: str, entity: str, *rules: tuple, match: str = "all", **more) -> dict:
    return {"name": name, "entity": entity, "signal": "rule", "params": {"match": match, "rules": [{"attr": a, "op": o} | ({"value": v[0]} if v else {}) for a, o, *v in rules]}, **more}


#: Shipped vocabulary.
DEFINITIONS = [
    _rule("large_order", "order_ctx", ("price", ">=", 200000.0)),
    _rule("many_lines", "order_ctx", ("lines", ">", 5)),
    _rule("has_returns", "order_ctx", ("returned_lines", ">=", 1), aliases=["returned"]),
    _rule("last_month", "order_ctx", ("is_last_month", "=", True)),
    _rule("urgent", "cust_order", ("priority", "in", ["1-URGENT", "2-HIGH"])),
    _rule("first_order", "cust_order", ("prev_orderkey", "is_null")),
    _rule("odd_order", "cust_order", ("price", "<", 20000.0), ("recent_orders", "=", 0), match="any"),
    _rule("one_off", "cust_year", ("orders", "=", 1)),
    _rule("big_nation", "nation_year", ("revenue", ">", 1000000.0)),
    _rule("seller", "order_side", ("side", "=", "sell")),
    {"name": "big_spender", "entity": "cust_year", "basis": "prior_season", "signal": "percentile", "params": {"attr": "spend", "cohort": ["year"], "pctile": 90}},
    {"name": "low_spender", "entity": "cust_year", "signal": "percentile", "params": {"attr": "spend", "cohort": ["year", "segment"], "direction": "bottom", "pctile": 25}},
    {"name": "busy", "entity": "cust_year", "signal": "percentile", "params": {"attr": "orders", "cohort": ["year"], "pctile": 50, "eligible": [{"attr": "orders", "op": ">=", "value": 1}]}},
    {"name": "top_customer", "entity": "cust_year", "signal": "rank", "params": {"attr": "spend", "cohort": ["year", "nationkey"], "top_n": 1}},
    {"name": "smallest", "entity": "cust_year", "signal": "rank", "params": {"attr": "spend", "cohort": ["year"], "direction": "bottom", "top_n": 10}},
    {"name": "price_jump", "entity": "cust_order", "signal": "delta", "params": {"attr": "price", "baseline": "recent_price", "kind": "ratio", "op": ">=", "value": 1.5, "min_baseline": 60000}},
    {"name": "price_drop", "entity": "cust_order", "signal": "delta", "params": {"attr": "price", "baseline": "recent_price", "kind": "diff", "op": "<", "value": -50000}},
    {"name": "notable", "entity": "cust_order", "signal": "composite", "params": {"op": "all_of", "terms": ["urgent", "large_order"]}},
    {"name": "unusual", "entity": "cust_order", "signal": "composite", "params": {"op": "any_of", "terms": ["price_jump", "price_drop"]}},
    {"name": "not_urgent", "entity": "cust_order", "signal": "composite", "params": {"op": "not", "terms": ["urgent"]}},
    {"name": "loyal_notable", "entity": "cust_order", "signal": "composite", "params": {"op": "all_of", "terms": ["big_spender", "large_order"]}},
]
