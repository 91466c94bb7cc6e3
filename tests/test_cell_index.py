"""The stored cell index: recall against brute force, proofs of exact search, and what is read."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import cell_index
from gaugeworks.operators.vectors import knn_cosine

ITEMS = "item_id long, embedding array<float>"
QUERIES = "query_id long, embedding array<float>"


def clustered(n, dim=24, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + rng.normal(0, 0.35, (n, dim))


def frames(spark, items, queries):
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], ITEMS)
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], QUERIES)
    return left, right


def rows(hits):
    return sorted(tuple(r) for r in hits.select("query_id", "rank", "item_id", "score").collect())


def test_recall_and_exact_search(spark, tmp_path):
    items, queries = frames(spark, clustered(1500), clustered(30, seed=4))
    index = cell_index.write_cells(items, 25, str(tmp_path))
    truth = rows(knn_cosine(items, queries, 20))
    near = {(q, i) for q, _, i, _ in truth}
    quick = cell_index.search(index, queries, 20, probes=8)
    found = {(q, i) for q, _, i, _ in rows(quick.hits)}
    assert len(found & near) / len(near) >= 0.9
    assert quick.visited.count() == 30 * 8
    proven = cell_index.search(index, queries, 20, probes=4, exact=True)
    assert rows(proven.hits) == truth
    # clusters apart from a query are never opened
    assert proven.visited.count() < 0.8 * 30 * index.cells.count()


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Vectors almost without clusters, the hardest case: four cells in ten find nine neighbours in ten."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = cell_index.write_cells(items, 45, str(tmp_path))
    truth = {(q, i) for q, _, i, _ in rows(knn_cosine(items, queries, 20))}
    found = {(q, i) for q, _, i, _ in rows(cell_index.search(index, queries, 20, probes=18).hits)}
    assert len(found & truth) / len(truth) >= 0.9


@pytest.mark.parametrize("part_vectors, query_block", [(20, 7), (50_000, 1024)])
def test_big_cells_and_many_queries(spark, tmp_path, monkeypatch, part_vectors, query_block):
    monkeypatch.setattr(cell_index, "PART_VECTORS", part_vectors)
    monkeypatch.setattr(cell_index, "QUERY_BLOCK", query_block)
    points = clustered(300, dim=10)
    points[50:150] = points[0]  # one vector a hundred times: a hot cell, and ties
    items, queries = frames(spark, points, np.vstack([points[:1], clustered(20, dim=10, seed=9)]))
    index = cell_index.write_cells(items, 6, str(tmp_path))
    assert (index.cells.agg(F.max("parts")).first()[0] > 1) == (part_vectors == 20)
    assert rows(cell_index.search(index, queries, 15, probes=2, exact=True).hits) == rows(knn_cosine(items, queries, 15))


def test_edges(spark, tmp_path):
    vectors = [(i, [float(i % 3), 1.0, float(i % 5), 0.5, -1.0]) for i in range(20)]
    vectors += [(100, None), (101, []), (102, [0.0] * 5), (103, [-1.0, -1.0, -1.0, -1.0, 1.0])]
    items = spark.createDataFrame(vectors, ITEMS)
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 0.5, -1.0]), (2, None), (3, []), (4, [0.0] * 5)], QUERIES)
    index = cell_index.write_cells(items, 4, str(tmp_path / "a"))
    plain = items.filter("size(embedding) > 0"), queries.filter("size(embedding) > 0")
    assert rows(cell_index.search(index, queries, 50, probes=1, exact=True).hits) == rows(knn_cosine(*plain, 50))
    none = cell_index.write_cells(spark.createDataFrame([], ITEMS), 4, str(tmp_path / "b"))
    assert rows(cell_index.search(none, queries, 5, probes=2, exact=True).hits) == []
    assert rows(cell_index.search(index, spark.createDataFrame([], QUERIES), 5, probes=2).hits) == []


def test_prunes_folders_by_cell(spark, tmp_path):
    items, queries = frames(spark, clustered(300), clustered(3, seed=8))
    index = cell_index.write_cells(items, 10, str(tmp_path))
    probed = cell_index._near_cells(index, queries, 2).withColumn("least", F.lit(None).cast("double"))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        cell_index._candidates(index, cell_index.materialize(probed), queries, 10, 1).explain("formatted")
    scans = [line for line in plan.getvalue().splitlines() if "PartitionFilters" in line and "cell" in line]
    assert any("dynamicpruning" in line for line in scans)
    assert {p.name for p in tmp_path.joinpath("vectors").glob("cell=*")} == {f"cell={r['cell']}" for r in index.cells.filter("n > 0").collect()}
