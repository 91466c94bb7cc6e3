"""Data checks: each finds violating rows; zero violations is a pass.

Row-local checks on one table are folded into a single aggregation; checks that
need a grouping or another table run as their own small job and are unioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"
WARN = "warn"


@dataclass(frozen=True)
class RowCheck:
    """A check decided by one row alone; ``violates`` is true for a bad row."""

    name: str
    violates: Column
    severity: str = ERROR


@dataclass(frozen=True)
class TableCheck:
    """A check whose violations are the rows of ``violations``."""

    name: str
    violations: DataFrame
    severity: str = ERROR


def not_null(column: str, severity: str = ERROR) -> RowCheck:
    return RowCheck(f"not_null_{column}", F.col(column).isNull(), severity)


def accepted_values(
    column: str, values: Sequence, where: Column | None = None, severity: str = ERROR
) -> RowCheck:
    """NULL is never a violation; ``where`` restricts the rows looked at."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(list(values))
    return RowCheck(f"accepted_values_{column}", bad if where is None else (where & bad), severity)


def accepted_range(
    column: str, low: float | None = None, high: float | None = None, severity: str = ERROR
) -> RowCheck:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return RowCheck(f"accepted_range_{column}", bad, severity)


def violating_rows(df: DataFrame, check: RowCheck) -> DataFrame:
    return df.filter(F.coalesce(check.violates, F.lit(False)))


def unique(df: DataFrame, *columns: str, severity: str = ERROR) -> TableCheck:
    """Key values that occur more than once; keys with a NULL are ignored."""
    keyed = df.select(*columns)
    for c in columns:
        keyed = keyed.filter(F.col(c).isNotNull())
    repeated = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return TableCheck(f"unique_{'_'.join(columns)}", repeated, severity)


def no_repeats(df: DataFrame, columns: Sequence[str], name: str, severity: str = ERROR) -> TableCheck:
    """Groups with more than one row; NULL keys form groups too."""
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return TableCheck(name, repeated, severity)


def relationships(
    df: DataFrame, column: str, parent: DataFrame, parent_column: str, severity: str = ERROR
) -> TableCheck:
    """Foreign keys without a parent; a NULL key is not a violation.

    Keys are counted first, so a hot key crosses the network once per map task.
    """
    keys = df.select(column).filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = parent.select(F.col(parent_column).alias("_parent"))
    orphans = keys.join(known, F.col(column) == F.col("_parent"), "left_anti")
    return TableCheck(f"relationships_{column}", orphans, severity)


def reconciles(df: DataFrame, reason: Column, name: str = "reasons_reconcile") -> TableCheck:
    """Every row must carry exactly one outcome: classified = total, none NULL."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(reason).alias("classified_rows"),
    )
    gap = totals.filter("total_rows <> classified_rows")
    return TableCheck(name, gap)


def run_row_checks(df: DataFrame, table: str, checks: Sequence[RowCheck]) -> DataFrame:
    """One pass over the table, one result row per check."""
    aliases = [f"c{i}" for i in range(len(checks))]
    counts = df.agg(*[F.count_if(check.violates).alias(a) for a, check in zip(aliases, checks)])
    results = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(check.name).alias("check_name"),
                F.lit(check.severity).alias("severity"),
                F.col(a).alias("failures"),
            )
            for a, check in zip(aliases, checks)
        ]
    )
    return counts.select(F.inline(results))


def run_table_check(table: str, check: TableCheck) -> DataFrame:
    return check.violations.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(table).alias("table_name"),
        F.lit(check.name).alias("check_name"),
        F.lit(check.severity).alias("severity"),
        "failures",
    )


RESULT = "table_name string, check_name string, severity string, failures bigint"


def run_suite(
    tables: Sequence[tuple[str, DataFrame, Sequence[RowCheck], Sequence[TableCheck]]], one_by_one: bool = False
) -> DataFrame:
    """All checks of all tables: (table_name, check_name, severity, failures, status).

    ``one_by_one=True`` runs each in a job of its own before it returns, so that only one
    holds its shuffle files at a time; a result is a row per check.
    """
    parts: list[DataFrame] = []
    for name, df, row_checks, table_checks in tables:
        if row_checks:
            parts.append(run_row_checks(df, name, row_checks))
        parts += [run_table_check(name, check) for check in table_checks]
    if one_by_one:
        rows = [tuple(row) for part in parts for row in part.collect()]
        parts = [parts[0].sparkSession.createDataFrame(rows, RESULT)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    status = F.when(F.col("failures") == 0, "pass").otherwise(
        F.when(F.col("severity") == WARN, "warn").otherwise("fail")
    )
    return result.withColumn("status", status)
