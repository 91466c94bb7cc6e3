"""Dimensions and the fact of a star schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.keys import surrogate_key


@dataclass(frozen=True)
class Dimension:
    """A dimension to attach: its table, key column, natural key, carried attributes.

    ``hashed`` states that the key is the surrogate key of the natural one, as ``build_dimension`` makes it.
    """

    table: DataFrame
    key: str
    natural: str
    carry: tuple[str, ...] = ()
    hashed: bool = False


def build_dimension(df: DataFrame, key: str, natural: str, attributes: Sequence[str]) -> DataFrame:
    return df.select(surrogate_key(natural).alias(key), natural, *attributes)


def attach_keys(facts: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Left-join every dimension on its natural key; unknown members keep a NULL key.

    No join is hinted: small dimensions are broadcast on measured size, large
    ones go through a sort-merge join whose hot keys the adaptive planner splits. A hashed key
    is made after the last join: it is long and does not compress, so no shuffle should carry it.
    """
    out, late, found = facts, {}, []
    for number, dim in enumerate(dimensions):
        natural = f"_natural_{number}"
        found.append(natural)
        key = () if dim.hashed else (dim.key,)
        side = dim.table.select(F.col(dim.natural).alias(natural), *key, *dim.carry)
        out = out.join(side, out[dim.natural] == side[natural], "left")
        if dim.hashed:
            late[dim.key] = F.when(F.col(natural).isNotNull(), surrogate_key(natural))
    return out.withColumns(late).drop(*found)


def attach_attributes(df: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Left-join dimension attributes by surrogate key."""
    out = df
    for dim in dimensions:
        side = dim.table.select(F.col(dim.key).alias("_key"), *dim.carry)
        out = out.join(side, out[dim.key] == side["_key"], "left").drop("_key")
    return out
