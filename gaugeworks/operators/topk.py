"""Top-k scoring of many items against many queries, without forming the pairs.

Items stay where they are; the queries travel. Each task scores a batch of
items against a block of queries as one matrix and emits only the best ``k``
items per query of that batch, so the output of a task is bounded by
``k x queries`` per batch and never by the number of pairs. The batch winners are
then ranked per query (limited again before the shuffle).

Up to ``QUERY_BLOCK`` queries form one block that is shipped with the task.
More queries are cut into blocks that are joined with chunks of the items by
(block, chunk): still exact, still bounded per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.dedup import top_per_group
from gaugeworks.session import materialize

QUERY_BLOCK = 1024
ITEM_CHUNK = 20_000
MATRIX_CELLS = 4_000_000
SCORE_DIGITS = 6

# (queries) -> (items) -> score matrix of shape (items, queries); NaN = no match.
Scorer = Callable[[pa.Table], Callable[[pa.Table], np.ndarray]]


def best_of_batch(
    item_ids: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, k: int
) -> pd.DataFrame:
    """The ``k`` best items per query of one score matrix; ties go to the lower id."""
    rounded = np.round(np.where(np.isnan(scores), -np.inf, scores), SCORE_DIGITS)
    keep_items, keep_queries, keep_scores = [], [], []
    for column, query_id in enumerate(query_ids):
        values = rounded[:, column]
        rows = np.flatnonzero(values > -np.inf)
        if len(rows) > k:
            floor = np.partition(values[rows], len(rows) - k)[len(rows) - k]
            rows = rows[values[rows] >= floor]
        rows = rows[np.lexsort((item_ids[rows], -values[rows]))][:k]
        keep_items.append(item_ids[rows])
        keep_scores.append(values[rows])
        keep_queries.append(np.full(len(rows), query_id))
    return pd.DataFrame(
        {
            "query_id": np.concatenate(keep_queries),
            "item_id": np.concatenate(keep_items),
            "score": np.concatenate(keep_scores),
        }
    )


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_pandas().to_numpy()


def _score_table(items: pa.Table, query_ids: np.ndarray, score, k: int) -> Iterator[pa.RecordBatch]:
    step = max(1, MATRIX_CELLS // max(1, len(query_ids)))
    for start in range(0, items.num_rows, step):
        part = items.slice(start, step)
        best = best_of_batch(_ids(part, "item_id"), query_ids, score(part), k)
        if len(best):
            yield from pa.Table.from_pandas(best, preserve_index=False).to_batches()


def scored_topk(
    items: DataFrame, queries: DataFrame, scorer: Scorer, k: int, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, item_id, score, rank) for the ``k`` best items of each query.

    ``items`` has ``item_id``, ``queries`` has ``query_id``; other columns are for the scorer.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, item_id {item_type}, score double"

    # One more row than fits tells whether the queries are within the bound.
    block = queries.limit(query_block + 1).toArrow()
    if block.num_rows <= query_block:

        def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids = _ids(block, "query_id")
            score = scorer(block)
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    yield from _score_table(pa.Table.from_batches([batch]), query_ids, score, k)

        winners = items.mapInArrow(score_partition, schema)
    else:
        winners = _blocked(items, queries, scorer, k, query_block, schema)

    order = [F.col("score").desc(), F.col("item_id").asc()]
    return top_per_group(winners, ["query_id"], order, k)


def _blocked(
    items: DataFrame, queries: DataFrame, scorer: Scorer, k: int, query_block: int, schema: str
) -> DataFrame:
    queries = materialize(queries)  # counted, then read by every chunk of items
    blocks = -(-queries.count() // query_block)
    chunks = max(1, -(-items.count() // ITEM_CHUNK))

    def number(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(buckets)))

    def spread(df: DataFrame, name: str, buckets: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1))))

    item_side = spread(number(items, "item_id", "chunk", chunks), "block", blocks)
    query_side = spread(number(queries, "query_id", "block", blocks), "chunk", chunks)

    def score_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table(
            {
                "query_id": right.column("query_id").slice(0, 0),
                "item_id": left.column("item_id").slice(0, 0),
                "score": pa.array([], pa.float64()),
            }
        )
        if not left.num_rows or not right.num_rows:
            return empty
        parts = list(_score_table(left, _ids(right, "query_id"), scorer(right), k))
        return pa.Table.from_batches(parts) if parts else empty

    return (
        item_side.groupBy("block", "chunk")
        .cogroup(query_side.groupBy("block", "chunk"))
        .applyInArrow(score_pair, schema)
    )
