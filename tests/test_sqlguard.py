import pytest

from termwright.plans.run import QueryTimeout
from termwright.sqlguard import Rejected, answer, run_sql, validate


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return {"region": spark.read.parquet(f"{sf_dir}/region.parquet")}


@pytest.mark.parametrize(
    "sql",
    [
        "", "  ", "drop table x", "select 1; select 2", "insert into region select 1", "with a as (select 1) delete from a", "select 'a", "select 1 /* x", "explain select 1", "set x = 1", "show tables",
        "create view v as select 1", "cache table region", "add jar '/tmp/x.jar'", "describe region", "use other",
        "SELECT TRANSFORM(r_name) USING 'id -un' AS (x string) FROM region", "select reflect('java.lang.System', 'getProperty', 'user.name')", "select java_method('java.lang.System', 'lineSeparator')",
        "select try_reflect('java.lang.System', 'lineSeparator')", "SELECT * FROM secret WHERE ', secret as (' <> ''", "select * from nation", "select 1 where exists (select 1 from secret)",
        "select (select max(x) from secret) as x from region", "select * from parquet.`/root/testdata/sf0.001/region.parquet`", "select * from csv.`/etc/passwd`", "select input_file_name() from region",
        "select * from range(10)", "with a as (select * from secret) select 1 from region", "select * from region where r_regionkey in (select x from secret)", "select * from default.secret",
    ],
)
def test_rejected(spark, views, sql):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("secret")
    with pytest.raises(Rejected):
        validate(spark, sql, views)


@pytest.mark.parametrize(
    "sql, n",
    [
        ("select 'drop; delete' as a -- drop\n", 1), ("with a as (select * from region) select * from a", 5), ("select r_name as `set`, replace(r_name, 'A', 'B') as update_of from region", 5),
        ("select * from region r where exists (select 1 from region s where s.r_regionkey = r.r_regionkey + 1)", 4), ("select r_name, row_number() over (order by r_name) as nth from region", 5),
        ("select r_name from region union select r_name from region", 5), ("select count(*) as n from region having count(*) > 2", 1), ("select * from (values (1), (2)) as t(a)", 2),
        ("with a as (select 1 as x), b as (select * from a) select * from b join region on r_regionkey = x", 1), ("select upper(r_name), substr(r_name, 1, 2), regexp_replace(r_name, 'A', '') from region", 5),
    ],
)
def test_allowed(spark, views, sql, n):
    assert run_sql(spark, sql, views, 100).count() == n


def test_limit_and_truncation(spark, views):
    assert run_sql(spark, "select * from region", views, 2).count() == 2
    got = answer(spark, "select r_regionkey from region order by 1", views, limit=3)
    assert [r["r_regionkey"] for r in got.rows] == [0, 1, 2] and got.truncated
    assert not answer(spark, "select * from region", views, limit=5).truncated


def test_no_view_stays(spark, views):
    run_sql(spark, "select * from region", views, 2).count()
    assert "region" not in {t.name for t in spark.catalog.listTables()}


def test_timeout(spark):
    views = {"big": spark.range(1 << 16).toDF("x")}
    with pytest.raises(QueryTimeout):
        answer(spark, "select count(*) as n from big a join big b on a.x % 7 >= b.x % 5 where length(repeat(cast(a.x as string), 300)) > b.x % 3", views, seconds=1)
