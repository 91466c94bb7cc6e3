"""The filter audit against applying every order to every document."""

import itertools
import re

import numpy as np
import pytest

from gaugeworks.llm import filter_audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(docs):
    """The set of failed filters of each document, from the words of the contract."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed.add("C")
        if re.search("[#$%&*|]", text):
            failed.add("D")
        if any(other is not None and doc_id is not None and other < doc_id and (t or "") == text for other, t, _ in docs):
            failed.add("E")
        out.append(failed)
    return out


def brute_force(docs, labels):
    failed = failures(docs)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(d[0], f) for d, f in zip(docs, failed) if (d[2] or "") == part]
        taken, found = {x: 0 for x in "ABCDE"}, []
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, name in enumerate(order, 1):
                gone = [d for d, f in alive if name in f]
                alive = [(d, f) for d, f in alive if name not in f]
                taken[name] += len(gone)
                redundant = sum(name in f for _, f in mine) - len(gone)
                unique = sum(f == {name} for _, f in mine)
                lost = [sum(d in marked for d in gone) for marked in (good, toxic)]
                found.append((part, "".join(order), step, len(alive), len(gone), redundant, unique, *lost, name))
        rows += [(*r[:-1], taken[r[-1]]) for r in found]
    return sorted(rows)


def run(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


long_text = " ".join(f"w{i}" for i in range(250))
repeated = "one two " * 150
EDGE = [
    (1, long_text, "en"),
    (2, long_text, "en"),
    (2, long_text, "en"),
    (1, long_text, "de"),
    (None, long_text, "en"),
    (3, None, "de"),
    (4, "", None),
    (5, "", ""),
    (None, "", None),
    (6, repeated, "fr"),
    (7, repeated + "#", "fr"),
    (8, "LOUD " * 300, "en"),
    (9, long_text + "\x0b|", None),
    (10, " ".join(f"v{i}" for i in range(199)), "de"),
    (11, " ".join(f"v{i}" for i in range(200)), "de"),
    (12, "ab " * 100 + " ".join(f"u{i}" for i in range(99)), "de"),
    (13, "A" * 3 + "b" * 97, "en"),
    (14, "A" * 4 + "b" * 96, "en"),
    (15, "漢 " * 100_000, "en"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, None, 1), (4, 1, None)]


def test_edges(spark):
    assert run(spark, EDGE, MARKS) == brute_force(EDGE, MARKS)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, EDGE, []) == brute_force(EDGE, [])


def test_clashing_columns(spark):
    docs = spark.createDataFrame(EDGE, DOCS).selectExpr("*", "1 as mask", "'x' as part", "2 as n", "3 as quality", "4 as digest")
    labels = spark.createDataFrame(MARKS, LABELS).selectExpr("*", "'t' as text", "'l' as lang", "5 as good")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    assert got == brute_force(EDGE, MARKS)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_walk_equals_counting(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(0, 9, (1 << n, 3))
    states = filter_audit.walk(counts.copy())
    for active in range(1 << n):
        alive = [m for m in range(1 << n) if not m & active]
        assert states[active].tolist() == counts[alive].sum(axis=0).tolist()


def test_other_filters_than_five(spark):
    """The walk and the orders serve any list of filters."""
    counted = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.steps(counted, "XY").collect()}
    assert len(got) == 4
    assert (got["XY", 1]["removed"], got["XY", 2]["removed"], got["YX", 1]["removed"], got["YX", 2]["removed"]) == (2, 4, 6, 0)
    assert got["YX", 2]["redundant"] == 2 and got["XY", 2]["unique_fails"] == 4 and got["YX", 1]["shapley"] == 10


def test_registered_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]
    docs, labels = read("documents", "doc_id", "text", "lang"), read("labels", "doc_id", "quality", "toxic")
    got = sorted(tuple(r) for r in entry.queries()["op12_filter_audit"](spark, sf).select(*COLUMNS).collect())
    assert got == brute_force(docs, labels)
