"""Every registered engine query against its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from termwright import queries as Q


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(pdf):
    show = lambda v: "null" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(Q.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(Q.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_fan_in_of_odd_keys_in_one_grouping(spark, tmp_path):
    orders = "o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate date"
    spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    made = [(1, "1-URGENT", "F", 250000.0), (2, "5-LOW", "O", 10.0), (2, None, None, None), (None, "1-URGENT", "F", 1.0), (9, "2-HIGH", "P", 7.0)]
    spark.createDataFrame(made, orders.rsplit(",", 1)[0]).selectExpr("*", "date'1996-02-29' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = Q.QUERIES["fan_in_ten_joins"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = Q.ORACLE_SQL["fan_in_ten_joins"]
    assert rows(got.toPandas()) == rows(c.sql(sql[sql.index("SELECT c_custkey, count") :]).df())
