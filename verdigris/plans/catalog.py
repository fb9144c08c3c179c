"""Discovery of tables, and SQL from outside run under a guard on its parsed plan."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Kinds of nodes of a parsed plan that only read; whatever else a statement parses to is refused.
READING = {
    "Project", "Filter", "Join", "UnresolvedJoin", "LateralJoin", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Distinct", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "Generate", "WithWindowDefinition", "Window",
    "Pivot", "Unpivot", "Sample", "LocalRelation", "ResolvedInlineTable", "Expand",
}
#: Groups of Spark's built-in functions that compute from their arguments alone. The others (``misc_funcs``, with calls
#: into the JVM and facts about the session) and functions that a user registered are refused unless they are named.
COMPUTING = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs",
    "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs", "variant_funcs", "xml_funcs",
}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Refused(ValueError):
    """The statement isn't a single query."""


def quote(name: str) -> str:
    """A plain identifier in backticks."""
    if not IDENTIFIER.fullmatch(name):
        raise Refused(f"not an identifier: {name!r}")
    return f"`{name}`"


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _known_relation(spark: SparkSession, parts: list[str], named: set[str]) -> bool:
    """A table, a view or one of the statement's own names; never a path behind the name of a format."""
    if len(parts) == 1 and parts[0].lower() in named:
        return True
    if len(parts) == 2 and not spark.catalog.databaseExists(parts[0]):
        return False
    return len(parts) <= 2 and all(map(IDENTIFIER.fullmatch, parts)) and spark.catalog.tableExists(".".join(parts))


def _check_function(spark: SparkSession, name: str, allowed: frozenset[str]) -> None:
    if name.lower() in allowed:
        return
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.lower()))
    if found.isEmpty() or found.get().getGroup() not in COMPUTING:
        raise Refused(f"not allowed: function {name}")


def check_query(spark: SparkSession, statement: str, functions: frozenset[str] = frozenset()) -> str:
    """The statement, if Spark parses it as one query made of nothing but what is allowed, subqueries included.

    Allowed are nodes that read, relations that the catalogue knows by name, and functions that compute from their arguments
    (or are named in ``functions``). The parsed plan is walked before anything is resolved, so no path is even looked at.
    """
    text = statement.strip().removesuffix(";").strip()
    if not re.match(r"(?is)\(*\s*(select|with)\b", text):
        raise Refused("only SELECT and WITH are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's errors have several classes
        raise Refused(f"it can't be parsed: {str(error).splitlines()[0]}") from None
    named, relations, todo = set(), [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name not in READING:
            raise Refused(f"not allowed: {name}")
        if name == "SubqueryAlias":
            named.add(node.alias().lower())
        if name == "UnresolvedRelation":
            relations.append([str(x) for x in _each(node.multipartIdentifier())])
        todo += [*_each(node.children()), *_each(node.innerChildren())]
        expressions = list(_each(node.expressions()))
        while expressions:
            one = expressions.pop()
            kind = one.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                _check_function(spark, ".".join(str(x) for x in _each(one.nameParts())), functions)
            elif kind == "UnresolvedGenerator":
                _check_function(spark, one.name().funcName(), functions)
            elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                todo.append(one.plan())
            elif "Reflect" in kind or "Python" in kind or "Scala" in kind:
                raise Refused(f"not allowed: {kind}")
            expressions += _each(one.children())
    for parts in relations:
        if not _known_relation(spark, parts, named):
            raise Refused(f"no such table: {'.'.join(parts)}")
    return text


def run_guarded(spark: SparkSession, statement: str, limit: int = 100, seconds: float | None = None) -> DataFrame:
    """The checked query's rows, at most ``limit``: the limit belongs to the plan, not to the text.

    With ``seconds`` the rows are there when it returns, or their jobs were cancelled and it raises ``OutOfTime``.
    """
    found = spark.sql(check_query(spark, statement)).limit(max(1, limit))
    return found if seconds is None else spark.createDataFrame(rows_within(found, seconds), found.schema)


class OutOfTime(TimeoutError):
    """The rows weren't there in time; their jobs were cancelled."""


def rows_within(df: DataFrame, seconds: float) -> list[Row]:
    """The rows of a short result, or ``OutOfTime``: from the limit on the jobs that make them are cancelled as they come."""
    context, tag, over = df.sparkSession.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()
    late = threading.Event()

    def watch() -> None:
        wait = seconds
        while not over.wait(wait):
            late.set()
            context.cancelJobsWithTag(tag)
            wait = 0.1

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        rows = df.collect()
    except Exception:
        if late.is_set():
            raise OutOfTime(f"no answer within {seconds:g} s") from None
        raise
    finally:
        over.set()
        context.removeJobTag(tag)
    return rows


def overview(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``name, rows, columns`` of some tables in one job."""
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def schema_text(tables: dict[str, DataFrame], rows: int = 2) -> str:
    """A compact description for a prompt: columns with types, and sample rows."""
    parts = []
    for name, df in sorted(tables.items()):
        columns = ", ".join(f"{c} {t}" for c, t in df.dtypes)
        samples = "".join(f"\n  {list(r)}" for r in df.limit(rows).collect()) if rows else ""
        parts.append(f"{name}({columns}){samples}")
    return "\n".join(parts)


def relevant_tables(question: str, tables: dict[str, list[str]], top: int = 18) -> list[str]:
    """Names of tables by the question's words in their names and columns: two points a word."""
    words = set(re.findall(r"\w{3,}", question.lower()))
    score = {t: 2 * sum(any(w in n.lower() for n in [t, *cs]) for w in words) for t, cs in tables.items()}
    return [t for t in sorted(score, key=lambda t: (-score[t], t)) if score[t] > 0][:top]
