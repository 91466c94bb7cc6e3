"""Lexical ranking: BM25 per field, best boosted field per document, top k per query."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import tokens
from gaugeworks.operators.topk import QUERY_BLOCK, scored_topk

# The usual BM25 parameters and the field boosts of passage search.
K1 = 1.2
B = 0.75
PASSAGE_BOOSTS = {"title": 2.0, "text": 1.0}


def field_statistics(
    words: DataFrame, boosts: Mapping[str, float], vocabulary: DataFrame
) -> DataFrame:
    """(field, term, docs_with_term, n_docs, total_length) for the terms that queries use.

    Counts are combined on the map side, so a term found in every document
    costs one row per task. A vocabulary small enough to broadcast is pushed
    below the aggregation by the optimizer; a large one meets counts, not words.
    """
    per_field = words.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in boosts]
            )
        )
    ).filter(F.size("words") > 0)
    lengths = per_field.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("words")).alias("total_length")
    )
    frequencies = (
        per_field.select("field", F.explode(F.array_distinct("words")).alias("term"))
        .groupBy("field", "term")
        .agg(F.count(F.lit(1)).alias("docs_with_term"))
        .join(vocabulary, "term", "left_semi")
    )
    return frequencies.join(lengths, "field")


def _scorer(boosts: Mapping[str, float]):
    """Scores documents whose fields arrive as token lists; statistics ride on the queries."""

    def prepare(queries: pa.Table):
        n_queries = queries.num_rows
        entries = queries.column("entries").combine_chunks()
        owner = pc.list_parent_indices(entries).to_numpy(zero_copy_only=False)
        flat = entries.flatten()
        term = flat.field("term").dictionary_encode()
        vocabulary = term.dictionary
        term_id = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        field_names = flat.field("field").to_numpy(zero_copy_only=False)
        weight = flat.field("weight").to_numpy(zero_copy_only=False)
        average = flat.field("average_length").to_numpy(zero_copy_only=False)

        plans = {}
        for name in boosts:
            mine = np.flatnonzero(field_names == name)
            if len(mine):
                mine = mine[np.argsort(term_id[mine], kind="stable")]
                starts = np.searchsorted(term_id[mine], np.arange(len(vocabulary) + 1))
                plans[name] = (starts, owner[mine], weight[mine], average[mine[0]])

        def score(items: pa.Table) -> np.ndarray:
            n = items.num_rows
            best = np.full((n, n_queries), -np.inf)
            for name, (starts, owners, weights, average_length) in plans.items():
                words = items.column(name).combine_chunks()
                row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
                length = np.bincount(row, minlength=n)
                hit = pc.index_in(words.flatten(), value_set=vocabulary)
                known = hit.is_valid().to_numpy(zero_copy_only=False)
                hit = hit.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cell, tf = np.unique(
                    row[known] * len(vocabulary) + hit[known], return_counts=True
                )
                doc, word = cell // len(vocabulary), cell % len(vocabulary)
                saturation = (
                    tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average_length))
                )
                # Spread each (doc, term) to the queries that ask for the term.
                fan = starts[word + 1] - starts[word]
                source = np.repeat(np.arange(len(word)), fan)
                first = np.cumsum(fan) - fan
                entry = np.arange(len(source)) - first[source] + starts[word[source]]
                target = doc[source] * n_queries + owners[entry]
                gain = saturation[source] * weights[entry]
                sums = np.bincount(target, gain, n * n_queries).reshape(n, n_queries)
                seen = np.bincount(target, minlength=n * n_queries).reshape(n, n_queries) > 0
                best = np.where(seen, np.maximum(best, sums), best)
            return np.where(np.isinf(best), np.nan, best)

        return score

    return prepare


def bm25_topk(
    docs: DataFrame,
    doc_id: str,
    fields: Mapping[str, str],
    queries: DataFrame,
    query_id: str,
    query_text: str,
    k: int,
    boosts: Mapping[str, float] | None = None,
    matching: DataFrame | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, item_id, score, rank): the ``k`` best documents for each query.

    ``fields`` maps field name -> column. Statistics come from all of ``docs``; ``matching``
    (default ``docs``) is the filtered part that may be returned.
    """
    boosts = dict(boosts or {name: 1.0 for name in fields})

    def analysed(df: DataFrame) -> DataFrame:
        words = [F.coalesce(tokens(c), F.array().cast("array<string>")).alias(f) for f, c in fields.items()]
        return df.select(F.col(doc_id).alias("item_id"), *words)

    wanted = (
        queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query_text)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    stats = field_statistics(analysed(docs), boosts, wanted.select("term").distinct())
    n, df = F.col("n_docs"), F.col("docs_with_term")
    boost = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])[F.col("field")]
    weight = F.log1p((n - df + 0.5) / (df + 0.5)) * F.col("qtf") * boost
    entries = (
        wanted.join(stats, "term")
        .groupBy("query_id")
        .agg(
            F.collect_list(
                F.struct(
                    "term",
                    "field",
                    weight.alias("weight"),
                    (F.col("total_length") / n).alias("average_length"),
                )
            ).alias("entries")
        )
    )
    pool = analysed(docs if matching is None else matching)
    return scored_topk(pool, entries, _scorer(boosts), k, query_block)
