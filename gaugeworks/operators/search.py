"""Evidence search: token match, keyword and range filters, sort, bucket counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import matches_any, tokens

# The searched fields, the result size and its bounds.
EVIDENCE_TEXT_FIELDS = ("assay_description", "compound_name", "target_name")
DEFAULT_HITS = 10


def multi_match(query: str, fields: Sequence[str]) -> Column:
    """Any token of the query in any of the fields."""
    return reduce(or_, [matches_any(f, query) for f in fields])


def bool_query(
    must: Sequence[Column] = (),
    filters: Sequence[Column] = (),
    should: Sequence[Column] = (),
    minimum_should_match: int = 0,
) -> Column:
    """All of ``must`` and ``filters``, and at least so many of ``should``."""
    condition = reduce(and_, [*must, *filters], F.lit(True))
    if should and minimum_should_match > 0:
        met = reduce(
            lambda a, b: a + b, [F.when(s, F.lit(1)).otherwise(F.lit(0)) for s in should]
        )
        condition = condition & (met >= minimum_should_match)
    return condition


def asked_for(limit: int | None, default: int) -> int:
    """The number of results asked for, or the default where none is stated; never another number."""
    wanted = default if limit is None else int(limit)
    if wanted < 1:
        raise ValueError(f"limit must be 1 or more, not {limit}")
    return wanted


def by_potency() -> list[Column]:
    """Strongest first, then by value, then by id."""
    return [
        F.col("pchembl_value").desc_nulls_last(),
        F.col("standard_value_nm").asc_nulls_last(),
        F.col("activity_id").asc(),
    ]


def search_evidence(
    evidence: DataFrame,
    *,
    query: str | None = None,
    target: str | None = None,
    resolve=lambda name: None,
    standard_type: str | None = None,
    max_value_nm: float | None = None,
    min_confidence: int | None = None,
    limit: int | None = DEFAULT_HITS,
) -> DataFrame:
    """Curated rows that match, strongest first.

    Text only filters; the order is by potency, then value, then id. ``limit`` is the number of rows
    asked for, the default where it is None; below 1 it is an error, and it has no upper bound. For many
    requests at once see ``bitmap_search.search_evidence_batch``.
    """
    conditions: list[Column] = []
    target_id = resolve(target) if target else None
    if target_id:
        conditions.append(F.col("target_chembl_id") == target_id)
    elif target:
        conditions.append(matches_any("target_name", target))
    if standard_type:
        conditions.append(F.col("standard_type") == standard_type)
    if max_value_nm is not None:
        conditions.append(F.col("standard_value_nm") <= float(max_value_nm))
    if min_confidence is not None:
        conditions.append(F.col("confidence_score") >= int(min_confidence))
    must = [multi_match(query, EVIDENCE_TEXT_FIELDS)] if query else []
    return (
        evidence.filter(bool_query(must=must, filters=conditions))
        .orderBy(*by_potency())
        .limit(asked_for(limit, DEFAULT_HITS))
    )


def terms_aggregation(df: DataFrame, field: str, buckets: int | None = None) -> DataFrame:
    """The values of a keyword field with their row counts: all, or the ``buckets`` most frequent ones."""
    counts = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("doc_count"))
    if buckets is None:
        return counts
    return counts.orderBy(F.col("doc_count").desc(), F.col(field).asc()).limit(buckets)


def term_counts(words: Column) -> Column:
    """array<struct<term, tf>> of a sorted word array: one entry per run of equal words."""
    at = F.filter(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)),
    )
    end = F.array_append(F.slice(at, 2, F.size(words)), F.size(words) + 1)
    return F.zip_with(
        at,
        end,
        lambda i, j: F.struct(F.get(words, i - 1).alias("term"), (j - i).cast("bigint").alias("tf")),
    )


def postings(df: DataFrame, doc_id: str, fields: Mapping[str, str]) -> DataFrame:
    """(field, term, doc_id, tf): how often each term occurs in each field of a document.

    A document is one row, so its terms are counted inside the row: sorted, then
    measured run by run. No word is shuffled.
    """
    sorted_words = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("field"), F.sort_array(tokens(column)).alias("words"))
                for name, column in fields.items()
            ]
        )
    )
    return (
        df.select(F.col(doc_id).alias("doc_id"), sorted_words)
        .filter(F.size("words") > 0)
        .select("field", "doc_id", F.inline(term_counts(F.col("words"))))
        .select("field", "term", "doc_id", "tf")
    )
