"""Filter interaction audit: what every order of the filters removes, from one pass over the texts.

Documents are counted into cells (part, mask of the filters they fail). A Gray-code walk over the
2^n sets of active filters toggles one filter at a time: every mask cell keeps a counter of the
active filters it fails, and the running survivors change by the cells whose counter leaves or
reaches zero. The survivors of every set are stored; each step of each order is a difference of
two of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE
from gaugeworks.session import materialize

# The thresholds of the audited filters.
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"

MEASURES = ("n", "good", "toxic")
STEP_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself; a NULL text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    count = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": count < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * count,
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def mask_of(failures: Mapping[str, Column]) -> Column:
    """One bit per filter, in the order given; an undecided condition is not a failure."""
    bits = [F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, failed in enumerate(failures.values())]
    return sum(bits[1:], bits[0])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per language and set of failed filters.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are not
    read. Only ids, digests and masks are shuffled. A document is a copy (filter E) if a smaller
    doc_id has the same text, by SHA-256. Of equal texts the rows of the least id pass; they are
    found by a join on digest *and* id, so that a large group of copies is dealt by its ids. A
    row without an id has no smaller one: it passes E, makes nobody a copy, and has no label.
    Repeated rows count each. A doc_id with several label rows is good (toxic) if one of them says so.
    """
    failures = text_failures(F.col("text"))
    rows = materialize(
        docs.select(
            "doc_id",
            F.coalesce("lang", F.lit("")).alias("part"),
            mask_of(failures).alias("mask"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        )
        .groupBy("doc_id", "part", "mask", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = rows.filter("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = (
        labels.filter("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
        )
    )
    copy = F.lit(1 << len(failures))
    judged = (
        named.join(first, ["digest", "doc_id"], "left")
        .join(flags, "doc_id", "left")
        .select(
            "part",
            F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + copy).alias("mask"),
            "n",
            (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    nameless = rows.filter("doc_id is null").select(
        "part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")
    )
    return judged.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def walk(counts: np.ndarray) -> np.ndarray:
    """The survivors of every set of active filters, from the (masks, measures) counts of the cells.

    Both arrays are indexed by bit masks. Sets are visited in Gray-code order, so each step toggles
    one filter and touches only the cells that fail it.
    """
    n_sets = len(counts)
    masks = np.arange(n_sets)
    active_failures = np.zeros(n_sets, dtype=np.int64)
    survivors = counts.sum(axis=0)
    states = np.empty_like(counts)
    states[0] = survivors
    active = 0
    for step in range(1, n_sets):
        toggled = step & -step
        active ^= toggled
        touched = (masks & toggled) > 0
        if active & toggled:
            survivors = survivors - counts[touched & (active_failures == 0)].sum(axis=0)
            active_failures[touched] += 1
        else:
            active_failures[touched] -= 1
            survivors = survivors + counts[touched & (active_failures == 0)].sum(axis=0)
        states[active] = survivors
    return states


@dataclass(frozen=True)
class Orders:
    """All orders of the filters, step by step, as sets before and after each step."""

    names: list[str]
    step: np.ndarray
    toggled: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, filters: str) -> Orders:
        orders = list(itertools.permutations(range(len(filters))))
        bits = 1 << np.array(orders, dtype=np.int64)
        return cls(
            ["".join(filters[i] for i in order) for order in orders for _ in order],
            np.tile(np.arange(1, len(filters) + 1), len(orders)),
            bits.reshape(-1),
            (np.cumsum(bits, axis=1) - bits).reshape(-1),
        )

    def steps(self, states: np.ndarray) -> pd.DataFrame:
        """One row per order and step of one part, all differences of stored states."""
        everything = len(states) - 1
        lost = states[self.before] - states[self.before | self.toggled]
        removed = lost[:, 0]
        total = np.zeros(len(states), dtype=np.int64)
        np.add.at(total, self.toggled, removed)
        survivors = states[:, 0]
        return pd.DataFrame(
            {
                "filter_order": self.names,
                "step": self.step,
                "kept": survivors[self.before | self.toggled],
                "removed": removed,
                "redundant": survivors[0] - survivors[self.toggled] - removed,
                "unique_fails": survivors[everything ^ self.toggled] - survivors[everything],
                "good_lost": lost[:, 1],
                "toxic_lost": lost[:, 2],
                "shapley": total[self.toggled],
            }
        )


def steps(counted: DataFrame, filters: str) -> DataFrame:
    """What each step of each order of ``filters`` keeps and removes, per part.

    ``counted`` is (part, mask, n, good, toxic) with one bit of the mask per filter. A part is one
    row of at most 2^n cells, and parts are dealt over the tasks. ``shapley`` is the number its
    filter removes, summed over all orders. No documents: no rows.
    """
    n_sets = 1 << len(filters)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def of_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = Orders.of(filters)
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"]):
                counts = np.zeros((n_sets, len(MEASURES)), dtype=np.int64)
                for cell in found:
                    counts[cell["mask"]] = [cell[m] for m in MEASURES]
                table = orders.steps(walk(counts))
                table.insert(0, "part", part)
                yield table

    return parts.mapInPandas(of_parts, STEP_SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five text filters A to E on whole texts, per language (NULL: empty string)."""
    return steps(cells(docs, labels), "ABCD" + COPY)
