"""Mergeable summaries: counts, extremes, distinct sketches and quantile sketches per group and batch.

A batch is reduced once to one row per group and stored in a folder of its own. Reading
merges the stored rows of all batches; no measurement is read again when one arrives.
Counts, largest and least values are exact. A distinct count is a HyperLogLog estimate with
a standard error of 1.04 / sqrt(2 ** DISTINCT_BITS), 0.8 %; the quantile a KLL sketch gives
has a rank within about 1 % of the one asked for, and is always a value that was measured.

Every state is summed inside the tasks before it is shuffled, so a hot group costs one
state per task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISTINCT_BITS = 14
QUANTILE_SIZE = 400


@dataclass(frozen=True)
class Summary:
    """What is kept of a group. Each mapping goes from output name to input column.

    ``rows`` names the count of rows. Columns counted distinct are integers, strings or binaries.
    """

    keys: tuple[str, ...]
    rows: str
    largest: Mapping[str, str] = field(default_factory=dict)
    least: Mapping[str, str] = field(default_factory=dict)
    distinct: Mapping[str, str] = field(default_factory=dict)
    quantiles: Mapping[str, str] = field(default_factory=dict)

    @property
    def outputs(self) -> tuple[str, ...]:
        return (self.rows, *self.largest, *self.least, *self.distinct, *self.quantiles)

    def __post_init__(self):
        names = [*self.keys, *self.outputs]
        if len(names) != len(set(names)):
            raise ValueError(f"a name is used twice: {', '.join(sorted(names))}")


def _number(column: str) -> Column:
    """NaN has no rank and does not take part."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def summarise(df: DataFrame, summary: Summary) -> DataFrame:
    """One row per group with the states of ``df``'s rows. NULL is a group; NULL values do not take part."""
    states = [F.count(F.lit(1)).alias(summary.rows)]
    states += [F.max(c).alias(out) for out, c in summary.largest.items()]
    states += [F.min(c).alias(out) for out, c in summary.least.items()]
    states += [F.hll_sketch_agg(c, DISTINCT_BITS).alias(out) for out, c in summary.distinct.items()]
    states += [F.kll_sketch_agg_double(_number(c), QUANTILE_SIZE).alias(out) for out, c in summary.quantiles.items()]
    return df.groupBy(*summary.keys).agg(*states)


def merge(states: DataFrame, summary: Summary) -> DataFrame:
    """One row per group from the rows of several ``summarise`` results."""
    merged = [F.sum(summary.rows).alias(summary.rows)]
    merged += [F.max(out).alias(out) for out in summary.largest]
    merged += [F.min(out).alias(out) for out in summary.least]
    merged += [F.hll_union_agg(out).alias(out) for out in summary.distinct]
    merged += [F.kll_merge_agg_double(out).alias(out) for out in summary.quantiles]
    return states.groupBy(*summary.keys).agg(*merged)


def estimate(states: DataFrame, summary: Summary, q: float = 0.5) -> DataFrame:
    """The states as numbers. A quantile of no value is NULL."""

    def quantile(out: str) -> Column:
        some = F.kll_sketch_get_n_double(out) > 0
        return F.when(some, F.kll_sketch_get_quantile_double(F.col(out), F.lit(q))).alias(out)

    exact = [summary.rows, *summary.largest, *summary.least]
    counts = [F.hll_sketch_estimate(out).alias(out) for out in summary.distinct]
    return states.select(*summary.keys, *exact, *counts, *[quantile(out) for out in summary.quantiles])


def write_batch(df: DataFrame, summary: Summary, path: str, batch: str) -> None:
    """Store the states of one batch. A batch that is written again replaces itself and nothing else."""
    if not batch or "/" in batch or batch.startswith((".", "_")):
        raise ValueError(f"not a name of a batch: {batch!r}")
    summarise(df, summary).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_states(spark: SparkSession, summary: Summary, path: str) -> DataFrame:
    """The merged states of all stored batches."""
    return merge(spark.read.parquet(path).drop("batch"), summary)


def read_estimates(spark: SparkSession, summary: Summary, path: str, q: float = 0.5) -> DataFrame:
    """The numbers of all stored batches together."""
    return estimate(read_states(spark, summary, path), summary, q)
