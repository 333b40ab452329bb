"""A guarded hatch for raw SQL: one SELECT over registered tables, bounded and timed.

The statement is parsed and analysed by Spark in a session of its own, in which the registered names are empty
stand-ins. What the analysed plan is made of must be on a list: no scripts, no tables but the stand-ins, no
functions that call into the JVM or read files. Only then the same statement is planned over the real tables, in
another session of its own, so no view is left behind in the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from termwright.plans.run import collect

#: Plan nodes a statement may be made of, by the names of Spark's logical plans.
NODES = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "GlobalLimit", "Intersect", "Join", "LocalLimit", "LocalRelation", "LogicalRDD",
    "Offset", "OneRowRelation", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedSubqueryColumnAliases", "View", "Window", "WithCTE",
}
#: Expressions that run code or tell about the machine, though built in.
DENIED = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "SparkVersion"}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


class Rejected(ValueError):
    """The statement may not run."""


@dataclass
class Answer:
    rows: list[dict]
    truncated: bool


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parse(spark: SparkSession, sql: str):
    """The parsed plan of one query; anything else, a second statement included, is refused before it is analysed."""
    if not sql.strip():
        raise Rejected("nothing to run")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Rejected(f"not one SELECT: {e.getCondition() or 'syntax error'}") from None
    return plan


def _walk(plan, visit) -> None:
    """visit(node, expressions) for every node, those inside expressions included."""
    todo = [plan]
    while todo:
        node = todo.pop()
        todo += _list(node.children())
        if _name(node) in ("WithCTE", "UnresolvedWith"):
            todo += _list(node.innerChildren())
        expressions, inner = _list(node.expressions()), []
        while expressions:
            e = expressions.pop()
            inner.append(e)
            expressions += _list(e.children())
            if "SubqueryExpression" in [c.getSimpleName() for c in _parents(e)]:
                todo.append(e.plan())
        visit(node, inner)


def _parents(thing) -> list:
    c, out = thing.getClass(), []
    while c is not None:
        out.append(c)
        c = c.getSuperclass()
    return out


def check_parsed(plan) -> None:
    """Names of one part only, no scripts or generators, and nothing that is a command: commands run while they are analysed."""

    def visit(node, expressions) -> None:
        kind = _name(node)
        if kind == "UnresolvedRelation":
            parts = _list(node.multipartIdentifier())
            if len(parts) > 1:
                raise Rejected(f"{'.'.join(parts)} is not a registered table")
        elif not (kind in NODES or kind in ("UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedInlineTable", "UnresolvedOrdinal", "Pivot", "UnresolvedPivot", "UnresolvedSubqueryColumnAliases")):
            raise Rejected(f"{kind} is not allowed")

    _walk(plan, visit)


def check_analysed(plan, stand_ins: set[str]) -> None:
    def visit(node, expressions) -> None:
        kind = _name(node)
        if kind not in NODES:
            raise Rejected(f"{kind} is not allowed")
        if kind == "View" and node.desc().identifier().unquotedString().lower() not in stand_ins:
            raise Rejected(f"{node.desc().identifier().unquotedString()} is not a registered table")
        for e in expressions:
            if _name(e) in DENIED or not e.getClass().getName().startswith(EXPRESSIONS):
                raise Rejected(f"{_name(e)} is not allowed")

    _walk(plan, visit)


def validate(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> None:
    """Raises Rejected unless the statement is one SELECT over nothing but the registered tables."""
    session = spark.newSession()
    for name, df in views.items():
        session.createDataFrame([], df.schema).createOrReplaceTempView(name)
    check_parsed(parse(session, sql))
    try:
        analysed = session.sql(sql)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        raise Rejected(f"{e.getCondition()}: {str(e).splitlines()[0]}") from None
    check_analysed(analysed, {v.lower() for v in views})


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int) -> DataFrame:
    """The statement's first `limit` rows, over nothing but the registered tables; file paths and catalog tables are refused."""
    validate(spark, sql, views)
    session = spark.newSession()
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return session.sql(sql).limit(int(limit))


def answer(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int = 500, seconds: float = 10) -> Answer:
    """At most `limit` rows and whether there are more, or QueryTimeout after `seconds`."""
    rows = collect(run_sql(spark, sql, views, limit + 1), seconds)
    return Answer(rows[:limit], len(rows) > limit)
