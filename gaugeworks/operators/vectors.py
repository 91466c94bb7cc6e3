"""Dense vectors: hashed text embedding, exact and cell-wise cosine top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import tokens
from gaugeworks.operators.topk import QUERY_BLOCK, scored_topk

EMBEDDING_DIM = 384
# Texts that are counted as one matrix.
MATRIX_ROWS = 256

# texts -> matrix of shape (texts, dim); built once per task by an encoder factory.
Encoder = Callable[[list[str]], np.ndarray]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal-length vectors as one float64 matrix (no row loop)."""
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def token_buckets(text: Column | str, dim: int = EMBEDDING_DIM) -> Column:
    """Feature hashing: the bucket of each token, from the first 32 bits of its md5."""
    return F.transform(
        tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast(
            "int"
        ),
    )


def bag_vectors(batches: Iterator[pa.RecordBatch], out: str, dim: int) -> Iterator[pa.RecordBatch]:
    """Batches with the buckets in column ``out`` replaced by unit vectors of their counts, ``MATRIX_ROWS`` rows each."""
    for whole in batches:
        at = whole.schema.get_field_index(out)
        for start in range(0, whole.num_rows, MATRIX_ROWS):
            batch = whole.slice(start, MATRIX_ROWS)
            buckets = batch.column(at)
            rows = pc.list_parent_indices(buckets).to_numpy(zero_copy_only=False)
            flat = buckets.flatten().to_numpy(zero_copy_only=False)
            n = batch.num_rows
            counts = np.bincount(rows.astype(np.int64) * dim + flat, minlength=n * dim)
            vectors = unit_rows(counts.reshape(n, dim).astype(np.float64)).astype(np.float32)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))
            columns = [lists if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def hashed_embedding(
    df: DataFrame, text: Column, dim: int = EMBEDDING_DIM, out: str = "embedding"
) -> DataFrame:
    """Adds an L2-normalised bag-of-tokens vector.

    Tokens and buckets are computed in the JVM; ``MATRIX_ROWS`` texts of an Arrow batch are counted
    and normalised as one matrix. Other columns pass through Python, so leave out what is not needed.
    """
    staged = df.withColumn(out, token_buckets(text, dim))
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema

    return staged.mapInArrow(lambda batches: bag_vectors(batches, out, dim), schema)


def encoded_embedding(
    df: DataFrame, text: Column, encoder_factory: Callable[[], Encoder], out: str = "embedding"
) -> DataFrame:
    """Adds the L2-normalised vector of a pluggable model, loaded once per task."""
    staged = df.withColumn(out, text)
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema

    def encode(batches):
        encoder = encoder_factory()
        for pdf in batches:
            matrix = unit_rows(np.asarray(encoder(pdf[out].fillna("").tolist()), dtype=np.float64))
            pdf[out] = list(matrix.astype(np.float32))
            yield pdf

    return staged.mapInPandas(encode, schema)


def cosine_scorer(queries: pa.Table):
    query_matrix = unit_rows(list_matrix(queries.column("embedding")))

    def score(items: pa.Table) -> np.ndarray:
        return unit_rows(list_matrix(items.column("embedding"))) @ query_matrix.T

    return score


def knn_cosine(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: (query_id, item_id, score = cosine, rank).

    ``items`` is (item_id, embedding), ``queries`` is (query_id, embedding). Filter either
    side beforehand; vectors that are NULL do not take part.
    """
    present = F.col("embedding").isNotNull()
    return scored_topk(
        items.select("item_id", "embedding").filter(present),
        queries.select("query_id", "embedding").filter(present),
        cosine_scorer,
        k,
    )


@dataclass(frozen=True)
class CellIndex:
    """Items with the cell of their vector, and the unit centre of every cell.

    Write ``items`` partitioned by ``cell``, and a search reads only the probed cells.
    """

    items: DataFrame
    centres: np.ndarray


def build_cells(items: DataFrame, cells: int, iterations: int = 10, seed: int = 7) -> CellIndex:
    """Group the vectors of (item_id, embedding) around ``cells`` centres with k-means."""
    dense = items.filter(F.col("embedding").isNotNull()).withColumn(
        "_raw", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    unit = Normalizer(inputCol="_raw", outputCol="_unit").transform(dense)
    means = KMeans(
        k=cells, featuresCol="_unit", predictionCol="cell", maxIter=iterations, seed=seed
    ).fit(unit)
    placed = means.transform(unit).drop("_raw", "_unit")
    return CellIndex(placed, unit_rows(np.array(means.clusterCenters())))


def nearest_cells(query_matrix: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(query_matrix @ centres.T), axis=1, kind="stable")[:, :probes]


def cell_scorer(centres: np.ndarray, probes: int):
    """Cosine to the items of a query's nearest cells; other items do not match."""

    def prepare(queries: pa.Table):
        query_matrix = unit_rows(list_matrix(queries.column("embedding")))
        probed = np.zeros((len(query_matrix), len(centres)), dtype=bool)
        np.put_along_axis(probed, nearest_cells(query_matrix, centres, probes), True, axis=1)
        score_all = cosine_scorer(queries)

        def score(items: pa.Table) -> np.ndarray:
            cell = items.column("cell").to_numpy()
            return np.where(probed[:, cell].T, score_all(items), np.nan)

        return score

    return prepare


def knn_cells(index: CellIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Approximate cosine top-k: exact within the ``probes`` cells nearest to each query.

    With a bounded number of queries, cells that no query probes are not read.
    """
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    items = index.items.select("item_id", "embedding", "cell")
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if 0 < block.num_rows <= QUERY_BLOCK:
        vectors = unit_rows(list_matrix(block.column("embedding")))
        wanted = np.unique(nearest_cells(vectors, index.centres, probes))
        items = items.filter(F.col("cell").isin([int(c) for c in wanted]))
    return scored_topk(items, asked, cell_scorer(index.centres, probes), k)
