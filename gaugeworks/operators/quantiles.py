"""Exact quantiles per group without holding any group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in the
memory of one task. Here values are counted first, the counts are summed into
cells (a monotone step function of the value), and the cell that holds the wanted
rank is found from the small cell table. Cells are steps of the logarithm, so they
fit values of any scale; as a narrow band may still lie in one cell, that cell is
cut once more, into equal parts between its own least and largest value. Only the
part that holds the rank is ranked in detail.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 4096
PARTS_PER_CELL = 4096
# Above the exponent of the smallest double, so that magnitudes are positive.
LOWEST_OCTAVE = 1100
LAST_CELL = 2**63 - 1


def _cell(value: Column) -> Column:
    """Monotone in value: at most about 17 million cells over all doubles; NaN comes last."""
    octave = F.log2(F.abs(value)) + LOWEST_OCTAVE
    magnitude = F.coalesce(F.floor(octave * CELLS_PER_OCTAVE).cast("long"), F.lit(0))
    return F.when(F.isnan(value), LAST_CELL).when(value < 0, -magnitude).otherwise(magnitude)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[f"_{c}"])
    return condition


def rows_to_rank(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], q: float = 0.5) -> DataFrame:
    """The counted values that lie in the part of the cell that holds the rank, with the count of all below the part."""
    keys = list(keys)
    group = [*keys, "_measure"]
    melted = df.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(out).alias("_measure"), F.col(src).cast("double").alias("_value"))
                    for out, src in values.items()
                ]
            )
        ),
    ).filter(F.col("_value").isNotNull())

    counted = (
        melted.groupBy(*group, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cell", _cell(F.col("_value")))
    )

    cells = counted.groupBy(*group, "_cell").agg(
        F.sum("_n").alias("_n"), F.min("_value").alias("_from"), F.max("_value").alias("_to")
    )
    upto = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*group)
    position = q * (F.col("_total") - 1)
    holds_rank = (F.col("_through") > F.col("_low")) & (F.col("_through") - F.col("_n") <= F.col("_high"))
    rank = ["_low", "_high", "_share"]
    wanted = (
        cells.withColumn("_through", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(everything))
        .withColumn("_low", F.floor(position))
        .withColumn("_high", F.ceil(position))
        .withColumn("_share", position - F.col("_low"))
        .filter(holds_rank)
        .select(
            *[F.col(c).alias(f"_{c}") for c in [*group, "_cell"]],
            (F.col("_through") - F.col("_n")).alias("_before"),
            *rank,
            "_from",
            "_to",
        )
    )

    inside = counted.join(wanted, _same(counted, wanted, [*group, "_cell"])).drop(
        *[f"_{c}" for c in [*group, "_cell"]]
    )
    along = (F.col("_value") - F.col("_from")) / F.nullif(F.col("_to") - F.col("_from"), F.lit(0.0))
    part = F.coalesce(F.least(F.floor(along * PARTS_PER_CELL), F.lit(PARTS_PER_CELL - 1)), F.lit(0))
    inside = inside.withColumn("_part", part.cast("int"))
    place = [*group, "_cell", "_part"]
    parts = inside.groupBy(*place, "_before", *rank).agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*group, "_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        parts.withColumn("_through", F.col("_before") + F.sum("_n").over(upto))
        .filter(holds_rank)
        .select(
            *[F.col(c).alias(f"_{c}") for c in place],
            (F.col("_through") - F.col("_n")).alias("_start"),
        )
    )

    return inside.join(wanted, _same(inside, wanted, place)).drop(*[f"_{c}" for c in place])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, str], q: float = 0.5
) -> DataFrame:
    """One row per group with the interpolated quantile of each value column.

    ``values`` maps output name -> input column. NULLs are ignored; a group in
    which every value is NULL does not appear. NaN counts as the largest value.
    """
    keys = list(keys)
    ranked = rows_to_rank(df, keys, values, q)
    place = [*keys, "_measure", "_cell", "_part"]
    running = Window.partitionBy(*place).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_through", F.col("_start") + F.sum("_n").over(running))

    def reached(out: str, rank: str) -> Column:
        hit = (F.col("_measure") == out) & (F.col("_through") > F.col(rank))
        return F.min(F.when(hit, F.col("_value")))

    quantile = {}
    for out in values:
        low, high = reached(out, "_low"), reached(out, "_high")
        share = F.max(F.when(F.col("_measure") == out, F.col("_share")))
        between = F.when(high > low, low + (high - low) * share).otherwise(low)
        quantile[out] = between.alias(out)
    return ranked.groupBy(*keys).agg(*quantile.values())
