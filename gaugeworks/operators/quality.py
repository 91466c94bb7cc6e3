"""Data-quality metrics in long form, from one pass over the fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.rules import INCLUDED, RuleSet

Metric = tuple[str, str, Column]


def long_metrics(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Evaluate all aggregate columns in one aggregation, then unpivot.

    A UNION of one query per metric would scan the input once per metric.
    """
    aliases = [f"m{i}" for i in range(len(metrics))]
    row = df.agg(*[column.cast("double").alias(a) for a, (_, _, column) in zip(aliases, metrics)])
    rows = F.array(
        *[
            F.struct(
                F.lit(group).alias("metric_group"), F.lit(name).alias("metric"), F.col(a).alias("value")
            )
            for a, (group, name, _) in zip(aliases, metrics)
        ]
    )
    return row.select(F.inline(rows))


def percentage(condition: Column) -> Column:
    total = F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")
    return F.round(F.lit(100.0) * F.count_if(condition) / total, 1)


def volume_metrics(distinct: Mapping[str, str], rows: str = "total_measurements") -> list[Metric]:
    out: list[Metric] = [("volume", rows, F.count(F.lit(1)))]
    out += [("volume", name, F.count_distinct(F.col(c))) for name, c in distinct.items()]
    return out


def completeness_metrics(conditions: Mapping[str, Column]) -> list[Metric]:
    return [("completeness", name, percentage(cond)) for name, cond in conditions.items()]


def issue_metrics(conditions: Mapping[str, Column]) -> list[Metric]:
    return [("issue", name, F.count_if(cond)) for name, cond in conditions.items()]


def exclusion_metrics(rules: RuleSet, unknown_passes: Sequence[str] = ()) -> list[Metric]:
    """One count per rule; the set of reasons is known, so no grouping is needed."""
    reason = rules.reason(unknown_passes)
    return [("excluded_by_reason", name, F.count_if(reason == name)) for name in rules.reasons]


def exclusion_histogram(df: DataFrame, rules: RuleSet, unknown_passes: Sequence[str] = ()) -> DataFrame:
    return (
        df.select(rules.reason(unknown_passes).alias("exclusion_reason"))
        .filter(F.col("exclusion_reason") != INCLUDED)
        .groupBy("exclusion_reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def surplus_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of every key group, as one 'issue' metric."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double")
    return groups.agg(surplus.alias("value")).select(
        F.lit("issue").alias("metric_group"), F.lit(name).alias("metric"), "value"
    )
