"""Keep one row per key under a stated total order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.session import materialize


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key group.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so
    each map task sends at most one row per key: a hot key cannot pile up.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def keep_any(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; the survivor is the smallest row over all other columns."""
    rest = [c for c in df.columns if c not in set(keys)]
    order = [F.col(c).asc_nulls_last() for c in rest] or [F.col(k) for k in keys]
    return keep_first(df, keys, order)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, with their rank. Limited before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= k)


def distinct_counts(df: DataFrame, key: str, columns: Mapping[str, str], apart: bool = False) -> DataFrame:
    """One row per known ``key`` with the number of distinct values of each column (output name -> input column).

    Each column is made distinct in an aggregation of its own: its rows are as narrow as the column, where
    several ``count_distinct`` at once would copy every row once a column, all columns wide. A key whose
    values are all NULL in a column has NULL there. ``apart=True`` writes each count before the next one is
    made, so that ``df``, which is read once a column, is shuffled for one column at a time.
    """
    known = df.filter(F.col(key).isNotNull())
    out = None
    for name, column in columns.items():
        counted = known.select(key, F.col(column).alias("_value")).filter("_value is not null").distinct()
        counted = counted.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        counted = materialize(counted) if apart else counted
        out = counted if out is None else out.join(counted, key, "full")
    return out
