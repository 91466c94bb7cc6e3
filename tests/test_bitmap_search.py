"""Bitmap search against a loop over all requests and items."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import bitmap_search
from gaugeworks.operators.bitmap_search import MUST, SHOULD

ITEMS = "id long, name string, note string, kind string, value double"
REQUESTS = "request long, least_should int, name string, note string, kind string, other string, most double, hits int"


def made_items(n, seed=2):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon"]
    rows = [
        (i, " ".join(pick.sample(words, pick.randrange(0, 4))), pick.choice(["all x", "all y", None, ""]), pick.choice(["K", "k", None]), float(i % 17))
        for i in range(n)
    ]
    return [*rows, (n, None, None, None, None)]


ASKED = [
    (1, None, "alpha", None, None, None, None, None),
    (2, 0, "alpha beta", "x", None, None, None, 4),
    (3, 1, None, None, None, "gamma y", None, None),
    (4, 2, None, "all", "K", "delta", 9.0, None),
    (5, None, None, None, None, None, None, 3),
    (6, None, "nothing", None, None, None, None, None),
    (7, None, "  ,; ", None, None, None, None, None),
    (8, 1, "EPSILON", None, "k", None, 5.0, 100),
    (9, 3, None, "all", "K", "delta", None, None),
    (10, None, None, None, "K", None, -1.0, 2),
]


def tokens(text):
    return set((text or "").lower().replace("é", "e").replace(",", " ").replace(";", " ").split())


def brute_force(items, asked):
    out = []
    for request, least, name, note, kind, other, most, hits in asked:
        found = []
        for item in items:
            i, iname, inote, ikind, value = item
            must = [name is None or bool(tokens(name) & tokens(iname))]
            if least:
                should = [note is not None and bool(tokens(note) & tokens(inote)), kind is not None and kind == ikind]
                should.append(other is not None and bool(tokens(other) & (tokens(iname) | tokens(inote))))
                must.append(sum(should) >= least)
            if most is not None:
                must.append(value is not None and value <= most)
            if all(must):
                found.append(item)
        found.sort(key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
        for rank, item in enumerate(found if hits is None else found[:hits], 1):
            out.append((request, None if hits is None else rank, *item))
    return sorted(out, key=str)


def order():
    return [F.col("value").desc_nulls_last(), F.col("id").asc()]


def run(spark, index):
    requests = spark.createDataFrame(ASKED, REQUESTS)
    clauses = bitmap_search.union_of(
        [
            bitmap_search.clause_of(requests, 0, MUST, "name", ["name"]),
            bitmap_search.clause_of(requests, 1, SHOULD, "note", ["note"]),
            bitmap_search.keyword(requests, 2, SHOULD, F.col("kind"), "kind"),
            bitmap_search.clause_of(requests, 3, SHOULD, "other", ["name", "note"]),
        ]
    )
    asked = requests.select("request", "least_should", "most", "hits")
    hits = bitmap_search.search_batch(index, asked, clauses, {"value": "most"}, limit="hits")
    return sorted((tuple(r) for r in hits.select("request", "rank", "id", "name", "note", "kind", "value").collect()), key=str)


@pytest.mark.parametrize("bucket_items, list_places", [(16_384, 1024), (50, 5), (50, 0), (100_000, 10**6)])
def test_equals_loop(spark, tmp_path, monkeypatch, bucket_items, list_places):
    """Whatever the bucket size, and whether terms are held as lists, bitmaps or both."""
    monkeypatch.setattr(bitmap_search, "BUCKET_ITEMS", bucket_items)
    monkeypatch.setattr(bitmap_search, "LIST_PLACES", list_places)
    monkeypatch.setattr(bitmap_search, "REQUEST_BLOCK", 4)
    items = made_items(300)
    index = bitmap_search.write_bitmaps(spark.createDataFrame(items, ITEMS), "id", ["name", "note"], ["kind"], str(tmp_path), order())
    assert run(spark, index) == brute_force(items, ASKED)


def test_overfull_bucket_goes_on(spark, tmp_path, monkeypatch):
    """Forty thousand items in what the hash makes one bucket: two bitmaps, nothing lost."""
    monkeypatch.setattr(bitmap_search, "BUCKET_ITEMS", 10**6)
    items = spark.range(40_000).select("id", F.lit("same").alias("name"))
    index = bitmap_search.write_bitmaps(items, "id", ["name"], [], str(tmp_path), [F.col("id").asc()])
    requests = spark.createDataFrame([(1, "same")], "request long, name string")
    clauses = bitmap_search.clause_of(requests, 0, MUST, "name", ["name"])
    asked = requests.select("request", F.lit(0).alias("least_should"))
    found = bitmap_search.search_batch(index, asked, clauses)
    assert index.items.select("bucket").distinct().count() == 2
    assert found.select("id").distinct().count() == found.count() == 40_000


def test_empty_items_and_requests(spark, tmp_path):
    index = bitmap_search.write_bitmaps(spark.createDataFrame([], ITEMS), "id", ["name", "note"], ["kind"], str(tmp_path / "a"), order())
    assert run(spark, index) == []
    index = bitmap_search.write_bitmaps(spark.createDataFrame(made_items(5), ITEMS), "id", ["name"], ["kind"], str(tmp_path / "b"), order())
    none = spark.createDataFrame([], REQUESTS)
    clauses = bitmap_search.clause_of(none, 0, MUST, "name", ["name"])
    assert bitmap_search.search_batch(index, none, clauses, limit="hits").count() == 0


def test_equal_requests_share_their_bits(spark, tmp_path, monkeypatch):
    """Eight hundred requests of eight kinds: as many questions and rows of bits as for eight."""
    monkeypatch.setattr(bitmap_search, "BUCKET_ITEMS", 50)
    index = bitmap_search.write_bitmaps(spark.createDataFrame(made_items(300), ITEMS), "id", ["name"], ["kind"], str(tmp_path), order())
    requests = spark.range(800).select(
        F.col("id").alias("request"), F.lit(0).alias("least_should"),
        F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma").alias("name"),
        F.when(F.col("id") % 4 < 2, "K").alias("kind"), (F.col("id") % 8).cast("int").alias("hits"),
    )
    clauses = bitmap_search.clause_of(requests, 0, MUST, "name", ["name"]).unionByName(
        bitmap_search.keyword(requests, 1, MUST, F.col("kind"), "kind")
    )
    shared = bitmap_search.questions_of(requests, clauses, ["hits"])
    assert shared.questions.count() == 8
    assert bitmap_search.clause_bits(index, shared.clauses).count() <= 3 * index.items.select("bucket").distinct().count()
    hits = bitmap_search.search_batch(index, requests.select("request", "least_should", "hits"), clauses, limit="hits")
    found = {}
    for r in hits.collect():
        found.setdefault(r["request"], []).append((r["rank"], r["id"]))
    for request in range(800):
        assert sorted(found.get(request, [])) == sorted(found.get(request % 8, []))
    assert len(found[7]) == 7


def test_buckets_follow_the_order_of_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitmap_search, "BUCKET_ITEMS", 50)
    index = bitmap_search.write_bitmaps(spark.createDataFrame(made_items(300), ITEMS), "id", ["name"], ["kind"], str(tmp_path), order())
    by_place = [r["id"] for r in index.items.orderBy("bucket", "place").collect()]
    assert by_place == [r["id"] for r in index.items.orderBy(*order()).collect()]


def test_equal_values_are_analysed_once_and_items_looked_up_once(spark, tmp_path):
    """A value is a row per task and bucket, not per item; an item is a row, whatever the number of its questions."""
    items = spark.range(2000).select("id", F.when(F.col("id") < 1999, "alpha beta").alias("name")).coalesce(1)
    index = bitmap_search.write_bitmaps(items, "id", ["name"], [], str(tmp_path), [F.col("id").asc()])
    stored = index.items.coalesce(1).select("bucket", F.col("place").cast("smallint").alias("place"), F.col("name").alias("_0"))
    valued = stored.mapInArrow(
        bitmap_search._places_of_values([("name", True)]), "field string, analysed boolean, value string, bucket long, places array<smallint>"
    )
    assert [(r["value"], sorted(r["places"])) for r in valued.collect()] == [("alpha beta", list(range(1999)))]
    requests = spark.range(5).select(
        F.col("id").alias("request"), F.col("id").cast("int").alias("least_should"), F.lit("beta").alias("name")
    )
    clauses = bitmap_search.union_of([bitmap_search.clause_of(requests, n, SHOULD, "name", ["name"]) for n in range(3)])
    asked = bitmap_search.questions_of(requests, clauses, [])
    found = bitmap_search.matches(index, asked, together=True).collect()
    assert len(found) == 2000
    # at least none of three clauses is met by all, four of three by none
    assert sorted(len(r["questions"]) for r in found) == [1, *[4] * 1999]
