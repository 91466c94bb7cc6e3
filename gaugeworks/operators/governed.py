"""Governed SQL: one read-only query over allow-listed tables, with a bounded result.

The statement is parsed by Spark itself and the parsed plan is inspected; nothing
is decided from the text. Only known query nodes are let through, so commands,
table functions, file relations and dynamic identifiers are refused.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

# Serving schema, default and largest result, seconds a statement may take, tables open to ad-hoc SQL.
SERVING_SCHEMA = "marts"
DEFAULT_ROWS = 100
MAX_ROWS = 200
MAX_SECONDS = 5.0
OPEN_TABLES = (
    "mart_compound_target_potency",
    "mart_target_activity_summary",
    "mart_assay_quality",
    "mart_compound_profile",
    "mart_data_quality_summary",
    "dim_compound",
    "dim_target",
    "dim_assay",
    "dim_document",
    "graph_compound_target_edge",
    "graph_target_similarity",
)

# Query nodes of a parsed statement that only read.
READ_NODES = frozenset(
    """
    Project Filter Aggregate Sort Distinct GlobalLimit LocalLimit Offset Join LateralJoin Union
    Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation
    UnresolvedHaving WithWindowDefinition Generate Pivot Unpivot UnresolvedPivot OneRowRelation
    LocalRelation UnresolvedInlineTable PipeOperator Sample
    """.split()
)
EQUALITIES = frozenset(("EqualTo", "EqualNullSafe"))
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect", "input_file_name"))


class GovernanceError(ValueError):
    """The statement is not allowed."""


@dataclass(frozen=True)
class Policy:
    """What a statement may read, how many rows it gives, and how long it may take."""

    tables: Collection[str] = OPEN_TABLES
    schema: str = SERVING_SCHEMA
    default_rows: int = DEFAULT_ROWS
    max_rows: int = MAX_ROWS
    max_seconds: float = MAX_SECONDS


@dataclass(frozen=True)
class GovernedQuery:
    sql: str
    tables: tuple[str, ...]
    limit: int
    rows: DataFrame


def _items(scala_seq) -> Iterator:
    for i in range(scala_seq.size()):
        yield scala_seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _name_parts(node) -> tuple[str, ...]:
    return tuple(part.lower() for part in _items(node.multipartIdentifier()))


def _expressions(node) -> Iterator:
    stack = list(_items(node.expressions()))
    while stack:
        expression = stack.pop()
        yield expression
        stack.extend(_items(expression.children()))


def _check_function(expression) -> None:
    if _kind(expression) == "UnresolvedFunction":
        name = [part.lower() for part in _items(expression.nameParts())][-1]
        if name in REFUSED_FUNCTIONS:
            raise GovernanceError(f"function {name} is not allowed")


def _read_tables(node, ctes: frozenset[str], found: list[tuple[str, ...]]) -> None:
    kind = _kind(node)
    if kind not in READ_NODES:
        raise GovernanceError(f"only read-only queries are allowed, found {kind}")
    if kind == "UnresolvedRelation":
        parts = _name_parts(node)
        if not (len(parts) == 1 and parts[0] in ctes):
            found.append(parts)
        return
    if kind == "UnresolvedWith":
        # a definition sees the names before it; only then does it become visible
        for relation in _items(node.cteRelations()):
            _read_tables(relation._2(), ctes, found)
            ctes = ctes | {relation._1().lower()}
    for expression in _expressions(node):
        _check_function(expression)
        if "PlanExpression" in _class_names(expression):
            _read_tables(expression.plan(), ctes, found)
    for child in _items(node.children()):
        _read_tables(child, ctes, found)


def _class_names(expression) -> set[str]:
    names, cls = set(), expression.getClass()
    while cls is not None:
        names.add(cls.getSimpleName())
        cls = cls.getSuperclass()
    return names


def _refuse_shadow(spark: SparkSession, name: str, policy: Policy) -> None:
    """Raises where a bare name would read something else than the serving table of that name.

    A temporary view that is that table, as ``lake.bare_views`` makes them, hides nothing.
    """
    served = f"{policy.schema}.{name}"
    try:
        hidden = spark.catalog.getTable(name).isTemporary and spark.catalog.tableExists(served)
    except AnalysisException:
        return
    if hidden and not spark.table(name).sameSemantics(spark.table(served)):
        raise GovernanceError(f"a temporary view hides {name}; write {policy.schema}.{name}")


def check_sql(spark: SparkSession, sql: str, policy: Policy = Policy()) -> tuple[tuple[str, ...], int]:
    """The tables a statement reads and the row limit it gets; raises ``GovernanceError``."""
    if not sql or not sql.strip():
        raise GovernanceError("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as error:
        raise GovernanceError(f"not a single valid statement: {error}") from error

    found: list[tuple[str, ...]] = []
    _read_tables(plan, frozenset(), found)
    allowed = {t.lower() for t in policy.tables}
    names = []
    for parts in found:
        in_schema = len(parts) == 1 or (len(parts) == 2 and parts[0] == policy.schema)
        if not in_schema or parts[-1] not in allowed:
            raise GovernanceError(
                f"table {'.'.join(parts)} is not open; use one of {', '.join(sorted(allowed))}"
            )
        if len(parts) == 1:
            _refuse_shadow(spark, parts[0], policy)
        names.append(parts[-1])

    top = plan.child() if _kind(plan) == "UnresolvedWith" else plan
    limit = policy.default_rows
    if _kind(top) == "GlobalLimit":
        written = top.limitExpr().toString()
        limit = int(written) if written.isdigit() else policy.max_rows
    return tuple(dict.fromkeys(names)), min(limit, policy.max_rows)


def _at_most_one_row(node) -> bool:
    bound = node.maxRows()
    return bound.isDefined() and bound.get() <= 1


def _refuse_unlinked_joins(node) -> None:
    """Raises for a join of an optimised plan that has no equality, unless one side is a single row."""
    expressions = list(_expressions(node))
    if _kind(node) == "Join" and not any(_kind(e) in EQUALITIES for e in expressions):
        if not (_at_most_one_row(node.left()) or _at_most_one_row(node.right())):
            raise GovernanceError("a join needs an equality between its sides")
    for expression in expressions:
        if "PlanExpression" in _class_names(expression):
            _refuse_unlinked_joins(expression.plan())
    for child in _items(node.children()):
        _refuse_unlinked_joins(child)


def governed_sql(spark: SparkSession, sql: str, policy: Policy = Policy()) -> GovernedQuery:
    """Check and run: the result never has more rows than the policy allows, and no join is a cross join."""
    tables, limit = check_sql(spark, sql, policy)
    rows = spark.sql(sql).limit(limit)
    _refuse_unlinked_joins(rows._jdf.queryExecution().optimizedPlan())
    return GovernedQuery(sql, tables, limit, rows)


def governed_rows(spark: SparkSession, sql: str, policy: Policy = Policy()) -> list[Row]:
    """Check, run and fetch, at most ``policy.max_rows`` rows; a statement over its time is stopped.

    The time counts from the call, planning included, though only jobs can be stopped while they
    run. Jobs carry a tag of their own, so that no other work of the session is touched; the tag
    is cancelled again until the call returns, as a statement may be between two jobs.
    """
    begun = time.monotonic()
    query = governed_sql(spark, sql, policy)
    tag = f"governed-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        wait = policy.max_seconds - (time.monotonic() - begun)
        while not done.wait(max(0.0, wait)):
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)
            wait = 0.2

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    try:
        watcher.start()
        return query.rows.collect()
    except Exception as error:
        if late.is_set():
            raise GovernanceError(f"stopped after {policy.max_seconds:g} seconds") from error
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
