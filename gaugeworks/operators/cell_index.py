"""A stored vector index: items in folders by cell, short codes of what is left of them, exact re-ranking.

Unit vectors are grouped around centres; a cell is a folder, and a big cell is several parts. The
difference between a vector and its centre is written as one byte per stretch of components. The vector lies in its nearest cell, its code there and
in the second nearest one, so that neighbours on the far side of a border are seen. A search visits the cells nearest to a query, scores
codes by table look-ups, and scores the vectors of the best codes exactly.

No item of a cell can come closer to a query than the cell's rim. ``exact=True`` uses that to finish
a search: cells that can still reach the k-th score are scored in full, all others are proven not to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.dedup import top_per_group
from gaugeworks.operators.topk import SCORE_DIGITS, best_of_batch
from gaugeworks.operators.vectors import list_matrix, unit_rows
from gaugeworks.session import materialize

# The model is fitted on so many vectors at most, by a hash of their id; all are indexed.
TRAIN_VECTORS = 20_000
TRAIN_ROUNDS = 12
CODES = 64
STRETCH = 4
# Cells that hold a vector's code; the first is its home, where the vector is.
COPIES = 2
# A cell with more codes than this is several parts, each a task of its own.
PART_VECTORS = 50_000
# Queries that one task scores against a part at a time.
QUERY_BLOCK = 1024
# Candidates whose vectors are read, for each result asked for.
RERANK = 8
# Best codes that a part gives a query, for each result asked for.
PART_BEST = 2
# Cells of a matrix of scores.
MATRIX_CELLS = 4_000_000
# Bounds are sums of rounded numbers; scores are compared after rounding.
SLACK = 2e-5


@dataclass(frozen=True)
class Codec:
    """Unit centres (cells, dim) and the code words (stretches, codes, width) of what they leave."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def padded(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def residuals(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What the centres leave of unit vectors, padded to whole stretches: (rows, stretches, width)."""
        rest = np.zeros((len(unit), self.padded))
        rest[:, : unit.shape[1]] = unit - self.centres[cell]
        return rest.reshape(len(unit), self.words.shape[0], -1)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The nearest code word of every stretch, for unit vectors in their cells."""
        rest = self.residuals(unit, cell)
        codes = np.empty(rest.shape[:2], dtype=np.uint8)
        for s, words in enumerate(self.words):
            codes[:, s] = ((words**2).sum(axis=1) - 2 * rest[:, s] @ words.T).argmin(axis=1)
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The product of each query with each code word: (queries, stretches, codes)."""
        wide = np.zeros((len(queries), self.padded))
        wide[:, : queries.shape[1]] = queries
        return np.einsum("qsw,scw->qsc", wide.reshape(len(queries), self.words.shape[0], -1), self.words)


def _lloyd(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Plain k-means centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(TRAIN_ROUNDS):
        near = (-2 * points @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(items: DataFrame, cells: int, seed: int = 7) -> Codec:
    """Centres and code words from at most ``TRAIN_VECTORS`` vectors, those with the least hash of their id."""
    usable = items.filter("embedding is not null and size(embedding) > 0")
    sample = usable.orderBy(F.xxhash64("item_id"), "item_id").limit(TRAIN_VECTORS).select("embedding").toArrow()
    if not sample.num_rows:
        return Codec(np.zeros((0, 0)), np.zeros((0, 0, STRETCH)))
    unit = unit_rows(list_matrix(sample.column("embedding")))
    centres = unit_rows(_lloyd(unit, cells, seed))
    cell = (unit @ centres.T).argmax(axis=1)
    dim = unit.shape[1]
    codec = Codec(centres, np.zeros((-(-dim // STRETCH), 1, STRETCH)))
    rest = codec.residuals(unit, cell)
    words = [_lloyd(rest[:, s], CODES, seed + s) for s in range(rest.shape[1])]
    return Codec(centres, np.stack(words))


@dataclass(frozen=True)
class CellIndex:
    """``codes`` (cell, part, item_id, home, code) and ``vectors`` (cell, part, item_id, embedding) in
    folders by cell, ``cells`` (cell, parts, rim: the least cosine of its own vectors), and the codec."""

    codes: DataFrame
    vectors: DataFrame
    cells: DataFrame
    codec: Codec


def write_cells(items: DataFrame, cells: int, path: str, seed: int = 7) -> CellIndex:
    """Index every vector of ``items`` (item_id, embedding) under ``path``.

    NULL and empty vectors are left out. A zero vector lies at cosine 0 to everything and is kept.
    """
    spark = items.sparkSession
    codec = fit(items, cells, seed)
    kind = items.schema["item_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(list_matrix(pa.chunked_array([batch.column("embedding")])))
            cosine = unit @ codec.centres.T
            nearest = np.argsort(-cosine, axis=1, kind="stable")[:, :COPIES].astype(np.int32)
            home = pa.array(nearest[:, 0])
            for copy, cell in enumerate(nearest.T):
                codes = codec.encode(unit, cell)
                vector = batch.column("embedding") if copy == 0 else pa.nulls(len(cell), batch.schema.field("embedding").type)
                near = cosine[np.arange(len(cell)), cell]
                columns = [batch.column("item_id"), vector, pa.array(cell), home, pa.array(near)]
                columns.append(pa.array([c.tobytes() for c in codes], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "embedding", "cell", "home", "near", "code"])

    usable = items.select("item_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(
        "embedding is not null and size(embedding) > 0"
    )
    schema = f"item_id {kind}, embedding array<float>, cell int, home int, near double, code binary"
    placed = materialize(usable.mapInArrow(place, schema))
    at_home = F.col("cell") == F.col("home")
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / PART_VECTORS).cast("int").alias("parts"),
        F.count_if(at_home).alias("n"),
        F.min(F.when(at_home, F.col("near"))).alias("rim"),
    )
    sizes.write.mode("overwrite").parquet(f"{path}/cells")
    stored = spark.read.parquet(f"{path}/cells")
    dealt = placed.join(stored.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts").cast("int"))
    tables = {"codes": (dealt, ["item_id", "home", "code"]), "vectors": (dealt.filter(at_home), ["item_id", "embedding"])}
    for name, (rows, columns) in tables.items():
        laid = rows.select("cell", "part", *columns).repartition("cell", "part")
        laid.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
    model = [(codec.centres.tolist(), codec.words.tolist(), kind)]
    schema = "centres array<array<double>>, words array<array<array<double>>>, item_type string"
    spark.createDataFrame(model, schema).write.mode("overwrite").parquet(f"{path}/model")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    model = spark.read.parquet(f"{path}/model").first()
    kind = model["item_type"]
    codes = spark.read.schema(f"part int, item_id {kind}, home int, code binary, cell int").parquet(f"{path}/codes")
    vectors = spark.read.schema(f"part int, item_id {kind}, embedding array<float>, cell int").parquet(f"{path}/vectors")
    codec = Codec(np.array(model["centres"], dtype=np.float64), np.array(model["words"], dtype=np.float64))
    return CellIndex(codes, vectors, spark.read.parquet(f"{path}/cells"), codec)


def _near_cells(index: CellIndex, queries: DataFrame, probes: int | None) -> DataFrame:
    """(query_id, cell, near): the cosine to the centres of the ``probes`` nearest cells, or of all."""
    centres = index.codec.centres
    kind = queries.schema["query_id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            cosine = unit_rows(list_matrix(pa.chunked_array([batch.column("embedding")]))) @ centres.T
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(cosine)), order.shape[1])
            cell = order.reshape(-1)
            columns = [batch.column("query_id").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(cosine[row, cell])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cell", "near"])

    return queries.mapInArrow(nearest, f"query_id {kind}, cell int, near double")


def _visited(pairs: DataFrame) -> DataFrame:
    """The distinct cells, for pruning folders: no more than the index has, so they may be broadcast."""
    return F.broadcast(pairs.select("cell").filter("cell >= 0").distinct())


def _blocks_of(queries: pd.DataFrame, items: int) -> Iterator[pd.DataFrame]:
    """Queries by as many as make a matrix of bounded size with so many items."""
    step = max(1, MATRIX_CELLS // max(1, items))
    for start in range(0, len(queries), step):
        yield queries.iloc[start : start + step]


def _score_codes(codec: Codec, wanted: int):
    """The ``wanted`` best items of one part for each query of a block, by the estimates of their codes."""

    def score(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": queries["query_id"][:0], "home": items["home"][:0], "item_id": items["item_id"][:0], "estimate": np.zeros(0)})]
        if len(items):
            codes = np.frombuffer(b"".join(items["code"]), np.uint8).reshape(len(items), -1)
            ids, home, cell = items["item_id"].to_numpy(), items["home"].to_numpy(), items["cell"].iloc[0]
            best = min(wanted, len(items))
            for block in _blocks_of(queries, len(items)):
                unit = unit_rows(np.stack(block["embedding"].to_numpy()).astype(np.float64))
                estimate = np.repeat((unit @ codec.centres[cell])[:, None], len(items), axis=1)
                for s, table in enumerate(codec.tables(unit).transpose(1, 0, 2)):
                    estimate += table[:, codes[:, s]]
                take = np.argpartition(-estimate, best - 1, axis=1)[:, :best]
                row = np.repeat(np.arange(len(unit)), best)
                flat = take.reshape(-1)
                found.append(
                    pd.DataFrame({"query_id": block["query_id"].to_numpy()[row], "home": home[flat], "item_id": ids[flat], "estimate": estimate[row, flat]})
                )
        return pd.concat(found, ignore_index=True)

    return score


def _score_vectors(k: int):
    """The ``k`` nearest items of one part for each query of a block, of those that reach its ``least``."""

    def score(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": queries["query_id"][:0], "item_id": items["item_id"][:0], "score": np.zeros(0)})]
        if len(items):
            vectors = unit_rows(np.stack(items["embedding"].to_numpy()).astype(np.float64))
            ids = items["item_id"].to_numpy()
            for block in _blocks_of(queries, len(items)):
                unit = unit_rows(np.stack(block["embedding"].to_numpy()).astype(np.float64))
                scores = vectors @ unit.T
                scores[scores < block["least"].to_numpy() - SLACK] = np.nan
                some = np.flatnonzero(~np.isnan(scores).all(axis=0))
                if len(some):
                    found.append(best_of_batch(ids, block["query_id"].to_numpy()[some], scores[:, some], k))
        return pd.concat(found, ignore_index=True)

    return score


def _by_part(index: CellIndex, table: DataFrame, probed: DataFrame, queries: DataFrame, blocks: int):
    """``table`` and the queries of its probed cells (query_id, cell, least), grouped by part and block of queries."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    items = table.join(_visited(probed), "cell", "left_semi").select("*", every)
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = probed.join(index.cells.select("cell", "parts"), "cell").join(queries, "query_id")
    asked = asked.select("cell", part, block, "query_id", "embedding", "least")
    keys = ("cell", "part", "block")
    return items.groupBy(*keys).cogroup(asked.groupBy(*keys))


def _candidates(index: CellIndex, probed: DataFrame, queries: DataFrame, wanted: int, blocks: int) -> DataFrame:
    """(query_id, home, item_id, estimate) from the codes of the probed cells alone."""
    query, item = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.codes, "item_id")))
    return _by_part(index, index.codes, probed, queries, blocks).applyInPandas(
        _score_codes(index.codec, wanted), f"query_id {query}, home int, item_id {item}, estimate double"
    )


def _nearest(index: CellIndex, opened: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, item_id, score): of every opened cell's part no more than ``k`` items a query."""
    query, item = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.vectors, "item_id")))
    return _by_part(index, index.vectors, opened, queries, blocks).applyInPandas(
        _score_vectors(k), f"query_id {query}, item_id {item}, score double"
    )


def _scored(index: CellIndex, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score): the exact cosine of the candidates, from the folders of their cells."""
    at = candidates.select("query_id", F.col("home").alias("cell"), "item_id")
    vectors = index.vectors.join(_visited(at), "cell", "left_semi").select("cell", "item_id", F.col("embedding").alias("vector"))
    pairs = at.join(vectors, ["cell", "item_id"]).join(queries, "query_id")
    product = lambda x, y: x.cast("double") * y.cast("double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda total, x: total + x)
    length = F.sqrt(dot("vector", "vector")) * F.sqrt(dot("embedding", "embedding"))
    score = F.when(length > 0, dot("vector", "embedding") / length).otherwise(0.0)
    return pairs.select("query_id", "item_id", F.round(score, SCORE_DIGITS).alias("score"))


@dataclass(frozen=True)
class CellSearch:
    """The result (query_id, item_id, score, rank), and the (query_id, cell) pairs that were visited."""

    hits: DataFrame
    visited: DataFrame


def search(
    index: CellIndex, queries: DataFrame, k: int, probes: int, rerank: int = RERANK, exact: bool = False
) -> CellSearch:
    """The ``k`` nearest items by cosine of each of ``queries`` (query_id, embedding).

    Looks at the ``probes`` nearest cells and at the vectors of the ``k * rerank`` best codes. With
    ``exact`` it then scores every cell whose rim leaves room for the k-th score found, so the result
    is that of a full scan. A task gives ``k`` rows a query and part, and only rows that reach that
    score, never the pairs. Queries without a vector have no hits.
    """
    queries = materialize(
        queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
            "embedding is not null and size(embedding) > 0"
        )
    )
    order = [F.col("score").desc(), F.col("item_id").asc()]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    cells = materialize(_near_cells(index, queries, None if exact else probes))
    nearest = top_per_group(cells, ["query_id"], [F.col("near").desc(), F.col("cell").asc()], probes)
    first = materialize(nearest.select("query_id", "cell", F.lit(None).cast("double").alias("least")))
    by_estimate = [F.col("estimate").desc(), F.col("item_id").asc()]
    seen = _candidates(index, first, queries, PART_BEST * k, blocks).groupBy("query_id", "home", "item_id")
    best = top_per_group(seen.agg(F.max("estimate").alias("estimate")), ["query_id"], by_estimate, k * rerank)
    looked = materialize(best.select("query_id", "home", "item_id"))
    found = materialize(top_per_group(_scored(index, looked, queries), ["query_id"], order, k))
    if not exact:
        return CellSearch(found, first.select("query_id", "cell"))

    reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # the rim of a cell: its least cosine r to the centre; nothing in it is closer to a query at
    # cosine c than cos(angle(c) - angle(r)), and a query inside the rim may meet anything
    near, rim = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))) for c in ("near", "rim"))
    closest = F.cos(F.greatest(F.lit(0.0), F.acos(near) - F.acos(rim)))
    opened = materialize(
        cells.join(reached, "query_id", "left")
        .withColumn("least", F.coalesce("least", F.lit(-2.0)))
        .join(index.cells.select("cell", "rim"), "cell")
        .filter(closest >= F.col("least") - SLACK)
        .select("query_id", "cell", "least")
    )
    hits = top_per_group(_nearest(index, opened, queries, k, blocks), ["query_id"], order, k)
    visited = first.select("query_id", "cell").unionByName(opened.select("query_id", "cell")).distinct()
    return CellSearch(hits, visited)
