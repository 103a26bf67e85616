"""Guarded ad-hoc SQL: one SELECT, no writes, no file reads, a row limit, a time limit."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ROWS = 500
TIMEOUT_S = 10.0
#: Nodes that a parsed statement may consist of, at any depth; all others (writes, commands, scripts, file relations) are rejected.
_NODES = frozenset(
    """Project Aggregate Filter UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Deduplicate UnresolvedWith WithWindowDefinition SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation Join LateralJoin AsOfJoin Union Except Intersect Generate Pivot UnresolvedPivot Unpivot UnresolvedUnpivot
    Sample UnresolvedTableValuedFunction UnresolvedInlineTable ResolvedInlineTable LocalRelation UnresolvedHint Window""".split()
)
#: Nodes around the SELECT proper; below them stands the root that must not be a set operation.
_AROUND = frozenset("Sort GlobalLimit LocalLimit Offset Distinct UnresolvedWith WithWindowDefinition SubqueryAlias UnresolvedHint".split())
_SETS = frozenset("Union Except Intersect".split())
#: Functions that reach Java, files or the machine, and table functions that only make rows.
_FUNCTIONS_OUT = re.compile(r"^(?:(?:try_)?reflect|java_method|input_file_\w+|read_\w+|python_\w+|raise_error|assert_true)$")
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: The same functions as the analyser names them; a second look, past everything that parsing may hide.
_CLASSES_OUT = re.compile(r"(?:CallMethodViaReflection|TryReflect|InputFile|PythonUDF|RaiseError)")


class Rejected(ValueError):
    """The statement isn't a single SELECT that only reads tables and views."""


def strip_fences(text: str) -> str:
    m = re.search(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I)
    return (m.group(1) if m else text).strip()


#: Literals, quoted names and comments: what no rewriting may touch.
_FIXED = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)""", re.S)


def to_spark_dialect(sql: str, scale: int = 6) -> str:
    """Regex match operators and bare NUMERIC in the form Spark reads; literals, quoted names and comments stay untouched."""
    parts = _FIXED.split(sql)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"!~\*?", " NOT RLIKE ", parts[i])
        parts[i] = re.sub(r"(?<![<>=!])~\*?", " RLIKE ", parts[i])
        parts[i] = re.sub(r"(?i)\bnumeric\b(?!\s*\()", f"DECIMAL(38,{scale})", parts[i])
    return "".join(parts)


def _each(seq) -> Iterator:
    at = seq.iterator()
    while at.hasNext():
        yield at.next()


def _expressions(found) -> Iterator:
    todo = list(found)
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def _plans(root) -> Iterator:
    """Every plan node, those of common table expressions and of subqueries in expressions too; views are left closed."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        if node.nodeName() == "View":
            continue
        todo += _each(node.children())
        todo += [p for p in _each(node.innerChildren()) if hasattr(p, "nodeName") and "plans.logical" in p.getClass().getName()]
        if node.nodeName() == "LateralJoin":
            todo.append(node.right().plan())
        for e in _expressions(_each(node.expressions())):
            if e.getClass().getName().startswith("org.apache.spark.sql.catalyst.expressions") and hasattr(e, "plan") and any(s in e.getClass().getSimpleName() for s in ("Subquery", "Exists", "ListQuery")):
                if not e.getClass().getSimpleName().startswith("InSubquery"):
                    todo.append(e.plan())


def _parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001 - any parse error is a rejection
        raise Rejected(str(e).splitlines()[0]) from None


def _check_parsed(plan) -> None:
    core = plan
    while core.nodeName() in _AROUND:
        core = core.children().head()
    if core.nodeName() in _SETS:
        raise Rejected("a set operation at the root")
    for node in _plans(plan):
        kind = node.nodeName()
        if kind not in _NODES:
            raise Rejected(f"{kind} isn't allowed")
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1 and re.search(r"[/\\:*.]", node.multipartIdentifier().last()):
            raise Rejected("a file in place of a table")
        if kind == "UnresolvedTableValuedFunction" and node.name().last().lower() not in _TABLE_FUNCTIONS:
            raise Rejected(f"{node.name().last()} isn't allowed")
        for e in _expressions(_each(node.expressions())):
            if e.getClass().getSimpleName() in ("UnresolvedFunction", "UnresolvedGenerator"):
                name = e.nameParts().last() if e.getClass().getSimpleName() == "UnresolvedFunction" else e.name().funcName()
                if _FUNCTIONS_OUT.match(name.lower()):
                    raise Rejected(f"{name} isn't allowed")


def _check_analysed(plan) -> None:
    for node in _plans(plan):
        if node.nodeName() == "View":
            continue
        for e in _expressions(_each(node.expressions())):
            if _CLASSES_OUT.search(e.getClass().getSimpleName()):
                raise Rejected(f"{e.getClass().getSimpleName()} isn't allowed")


def checked(spark: SparkSession, text: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The statement's DataFrame with a limit where it has none at its root; raises :class:`Rejected` otherwise.

    The parsed plan is walked node by node before anything is analysed; files can't be named in place of tables while it
    is, and the analysed plan is walked for functions that came in another way.
    """
    sql = to_spark_dialect(strip_fences(text))
    plan = _parsed(spark, sql)
    _check_parsed(plan)
    files = spark.conf.get(_FILES, "true")
    spark.conf.set(_FILES, "false")
    try:
        df = spark.sql(sql)
    finally:
        spark.conf.set(_FILES, files)
    _check_analysed(df._jdf.queryExecution().analyzed())
    return df if plan.nodeName() in ("GlobalLimit", "LocalLimit") else df.limit(max_rows)


_FILES = "spark.sql.runSQLOnFiles"


def rows_within(spark: SparkSession, df: DataFrame, seconds: float = TIMEOUT_S) -> list:
    """The rows of a checked result, or none if it takes longer; its jobs are then cancelled."""
    tag = f"guard-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:  # noqa: BLE001 - errors of ad-hoc SQL give no rows
        return []
    finally:
        timer.cancel()
        spark.removeTag(tag)


def run(spark: SparkSession, text: str, max_rows: int = MAX_ROWS, seconds: float = TIMEOUT_S) -> list:
    try:
        return rows_within(spark, checked(spark, text, max_rows), seconds)
    except (Rejected, AnalysisException):
        return []


def as_results(df: DataFrame, order: list[str]) -> DataFrame:
    """id ``analytical:<i>`` and the non-null columns of each row as ``name: value`` joined by bars.

    For results that :func:`checked` has limited: numbering them in one order takes one task.
    """
    text = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in df.columns])
    nth = F.row_number().over(W.orderBy(*order)) - 1
    return df.select(F.concat(F.lit("analytical:"), nth.cast("string")).alias("id"), text.alias("content"))
