import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import checks, dedup, graph, quality, quantiles, search, star, topk, vectors
from gaugeworks.operators.bm25 import bm25_topk
from gaugeworks.operators.lookup import (
    GLOSSARY,
    GLOSSARY_ALIASES,
    alias_table,
    define_terms,
    glossary_table,
    resolve_name,
    resolve_names,
)
from gaugeworks.plans.contract_checks import curated_contract


def test_keep_first_order_and_nulls(spark, rows):
    df = spark.createDataFrame(
        [("a", 8.0, 5.0, 2), ("a", 8.0, 5.0, 1), ("a", 7.0, 1.0, 0), ("b", None, 3.0, 4), ("b", 1.0, 9.0, 5)],
        "k string, p double, nm double, id int",
    )
    order = [F.col("p").desc_nulls_last(), F.col("nm").asc_nulls_last(), F.col("id").asc()]
    assert rows(dedup.keep_first(df, ["k"], order), "k", "id") == [("a", 1), ("b", 5)]


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = dedup.keep_first(df, ["k"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_keep_any_is_deterministic(spark, rows):
    data = [("a", "y", 1), ("a", "x", 2), ("a", None, 0)]
    for shuffled in itertools.permutations(data):
        df = spark.createDataFrame(list(shuffled), "k string, v string, n int")
        assert rows(dedup.keep_any(df, ["k"])) == [("a", "x", 2)]


def quantile_oracle(values, q):
    return float(np.quantile(np.array(values, dtype=float), q))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles_match_numpy(spark, q):
    rng = random.Random(7)
    data = []
    for key, size in (("hot", 3000), ("small", 7), ("one", 1), ("even", 40)):
        for _ in range(size):
            a = rng.choice([rng.gauss(0, 1e6), rng.random(), 5.0, -3.25])
            data.append((key, a, rng.choice([None, 7.0, 8.0])))
    data.append(("none", None, None))
    df = spark.createDataFrame(data, "k string, a double, b double")
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], {"qa": "a", "qb": "b"}, q).collect()}
    for key in ("hot", "small", "one", "even"):
        a = [r[1] for r in data if r[0] == key and r[1] is not None]
        assert got[key]["qa"] == pytest.approx(quantile_oracle(a, q), rel=1e-12, abs=1e-12)
        b = [r[2] for r in data if r[0] == key and r[2] is not None]
        if b:
            assert got[key]["qb"] == pytest.approx(quantile_oracle(b, q))
    assert "none" not in got


def test_exact_quantiles_null_key_and_one_cell(spark):
    df = spark.createDataFrame([(None, 100.0 + i * 1e-9) for i in range(101)], "k string, v double")
    got = quantiles.exact_quantiles(df, ["k"], {"m": "v"}).collect()
    assert len(got) == 1 and got[0]["m"] == 100.0 + 50 * 1e-9


@pytest.mark.parametrize("scale, shift", [(1e-9, 0.0), (1e-5, 7.0), (-1e-300, 0.0), (1e-7, -3.0)])
def test_no_part_of_a_cell_holds_much_of_a_hot_group(spark, scale, shift):
    values = np.random.default_rng(2).random(4001) * scale + shift
    df = spark.createDataFrame([("hot", float(v)) for v in values], "k string, v double")
    ranked = quantiles.rows_to_rank(df, ["k"], {"m": "v"})
    assert ranked.groupBy("_cell", "_part").count().agg(F.max("count")).first()[0] <= 40
    assert quantiles.exact_quantiles(df, ["k"], {"m": "v"}).first()["m"] == np.median(values)


def test_quantiles_of_infinities(spark):
    df = spark.createDataFrame([(v,) for v in (-math.inf, 0.0, -0.0, 1.0, math.inf)], "v double")
    for q, value in ((0.0, -math.inf), (0.5, 0.0), (0.75, 1.0), (1.0, math.inf)):
        assert quantiles.exact_quantiles(df.withColumn("k", F.lit(1)), ["k"], {"m": "v"}, q).first()["m"] == value


def test_unknown_members_keep_null_keys(spark, rows):
    parts = spark.createDataFrame([("p1", "x")], "part string, name string")
    dim = star.build_dimension(parts, "part_key", "part", ["name"])
    facts = spark.createDataFrame([(1, "p1"), (2, "gone"), (3, None)], "id int, part string")
    keyed = star.attach_keys(facts, [star.Dimension(dim, "part_key", "part")])
    assert {r["id"]: r["part_key"] is None for r in keyed.collect()} == {1: False, 2: True, 3: True}


def test_hashed_keys_are_made_after_the_joins(spark):
    """No join carries a surrogate key; unknown members keep a NULL key."""
    facts = spark.createDataFrame([(1, 10, 7), (2, 99, 7), (3, None, 8)], "id int, part int, doc int")
    parts = star.build_dimension(spark.createDataFrame([(10,), (11,)], "part int"), "part_key", "part", [])
    docs = star.build_dimension(spark.createDataFrame([(7,)], "doc int"), "doc_key", "doc", [])

    def attached(hashed):
        dims = [star.Dimension(parts, "part_key", "part", hashed=hashed), star.Dimension(docs, "doc_key", "doc", hashed=hashed)]
        return star.attach_keys(facts, dims).select("id", "part", "doc", "part_key", "doc_key")

    assert sorted(attached(True).collect(), key=str) == sorted(attached(False).collect(), key=str)
    plan = attached(True)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan.split("Join")[0] and "md5" not in plan.split("Join", 1)[1]


def brute_pairs(pairs):
    by_member = {}
    for member, group in set(pairs):
        by_member.setdefault(member, set()).add(group)
    shared = Counter()
    for groups in by_member.values():
        shared.update(itertools.combinations(sorted(groups), 2))
    return shared


@pytest.mark.parametrize("light, block", [(64, 1024), (3, 4), (1, 2)])
def test_shared_members_brute_force(spark, light, block):
    rng = random.Random(3)
    pairs = [(f"m{rng.randrange(60)}", f"g{rng.randrange(12):02d}") for _ in range(400)]
    pairs += [("hot", f"g{i:02d}") for i in range(12)] * 50 + [(None, "g01"), ("m1", None)]
    df = spark.createDataFrame(pairs, "m string, g string")
    got = graph.shared_members(graph.memberships(df, "m", "g"), light, block)
    expected = brute_pairs([p for p in pairs if None not in p])
    assert {(r["group_a"], r["group_b"]): r["shared"] for r in got.collect()} == dict(expected)


def test_jaccard_and_neighbours(spark, rows):
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("d", "y"), ("a", "z")]
    df = spark.createDataFrame(pairs, "m string, g string")
    similarity = graph.jaccard_similarity(df, "m", "g")
    assert rows(similarity, "group_a", "group_b", "shared", "jaccard") == [
        ("x", "y", 2, 0.5),
        ("x", "z", 1, 0.3333),
        ("y", "z", 1, 0.3333),
    ]
    both = graph.symmetrize(similarity, ["group_a"], ["group_b"], ["shared"])
    assert rows(both.filter("source_0 = 'y'"), "neighbor_0", "shared") == [("x", 2), ("z", 1)]


def test_long_metrics_on_no_rows(spark, rows):
    empty = spark.createDataFrame([], "a int, b string")
    metrics = [
        *quality.volume_metrics({"kinds": "b"}, rows="total"),
        *quality.completeness_metrics({"pct": F.col("a").isNotNull()}),
    ]
    assert rows(quality.long_metrics(empty, metrics)) == [
        ("completeness", "pct", None),
        ("volume", "kinds", 0.0),
        ("volume", "total", 0.0),
    ]
    assert quality.surplus_rows(empty, ["a"], "dups").first()["value"] == 0.0


def test_surplus_counts_null_groups(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    assert quality.surplus_rows(df, ["a", "b"], "dups").first()["value"] == 2.0


def test_checks(spark, rows):
    df = spark.createDataFrame(
        [(1, "=", 8, "p"), (1, ">", None, "q"), (None, None, 99, None), (3, "?", 0, "p")],
        "id int, sign string, score int, parent string",
    )
    parents = spark.createDataFrame([("p",)], "parent string")
    suite = checks.run_suite(
        [
            (
                "t",
                df,
                [
                    checks.not_null("id"),
                    checks.accepted_values("sign", ["=", ">"], severity=checks.WARN),
                    checks.accepted_values("score", [8], F.col("id") == 1),
                    checks.accepted_range("score", 0, 9),
                ],
                [checks.unique(df, "id"), checks.relationships(df, "parent", parents, "parent")],
            )
        ]
    )
    assert {r["check_name"]: (r["failures"], r["status"]) for r in suite.collect()} == {
        "not_null_id": (1, "fail"),
        "accepted_values_sign": (1, "warn"),
        "accepted_values_score": (0, "pass"),
        "accepted_range_score": (1, "fail"),
        "unique_id": (1, "fail"),
        "relationships_parent": (1, "fail"),
    }


def test_contract_recheck_wants_positive_values(spark):
    df = spark.createDataFrame(
        [("IC50", "=", 0.0, 8.0, 9), ("IC50", None, 1.0, 8.0, 9), ("IC50", ">", 1.0, 8.0, 9)],
        "standard_type string, standard_relation string, standard_value_nm double, pchembl_value double, "
        "confidence_score int",
    )
    assert checks.violating_rows(df, curated_contract()).count() == 2


def test_reconciles(spark):
    df = spark.createDataFrame([("a",), (None,)], "reason string")
    assert checks.reconciles(df, F.col("reason")).violations.count() == 1
    assert checks.reconciles(df.filter("reason = 'a'"), F.col("reason")).violations.count() == 0


# ------------------------------------------------------------------------ search

DOCS = [
    (1, "EGFR kinase", "Kinase assay for EGFR, kinase inhibitor"),
    (2, "HER2", "cell proliferation assay with HER2 cells"),
    (3, "", "unrelated words only"),
    (4, "EGFR kinase", "Kinase assay for EGFR, kinase inhibitor"),
    (5, "Résumé", "kinase"),
]


def test_postings(spark, rows):
    df = spark.createDataFrame(DOCS, "id int, title string, body string")
    got = rows(search.postings(df, "id", {"body": "body"}).filter("doc_id = 1"), "term", "tf")
    assert got == [("assay", 1), ("egfr", 1), ("for", 1), ("inhibitor", 1), ("kinase", 2)]
    total = search.postings(df, "id", {"body": "body", "title": "title"}).agg(F.sum("tf")).first()[0]
    assert total == 6 + 6 + 3 + 6 + 1 + 2 + 1 + 2 + 1


def test_postings_need_no_shuffle(spark):
    df = spark.createDataFrame(DOCS, "id int, title string, body string")
    plan = search.postings(df, "id", {"body": "body"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def words_of(text):
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"\w+(?:[.'’]\w+)*", plain)


def brute_bm25(docs, query, boosts):
    best = {}
    for at, boost in boosts.items():
        fields = {d[0]: words_of(d[at]) for d in docs}
        filled = {k: w for k, w in fields.items() if w}
        average = sum(map(len, filled.values())) / len(filled)
        for doc, words in filled.items():
            score, tf = 0.0, Counter(words)
            for term, qtf in Counter(words_of(query)).items():
                df = sum(term in w for w in filled.values())
                if tf[term]:
                    idf = math.log(1 + (len(filled) - df + 0.5) / (df + 0.5))
                    norm = tf[term] + 1.2 * (0.25 + 0.75 * len(words) / average)
                    score += boost * qtf * idf * tf[term] * 2.2 / norm
            if score:
                best[doc] = max(best.get(doc, 0.0), score)
    return sorted(best.items(), key=lambda p: (-round(p[1], 6), p[0]))


@pytest.mark.parametrize("block", [1024, 1])
def test_bm25_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    asked = [(10, "kinase EGFR kinase"), (11, "assay"), (12, "nothing here"), (13, "resume")]
    queries = spark.createDataFrame(asked, "qid int, q string")
    hits = bm25_topk(
        docs, "id", {"title": "title", "body": "body"}, queries, "qid", "q", 3, {"title": 2.0, "body": 1.0},
        query_block=block,
    ).collect()
    for qid, text in asked:
        got = sorted((r["rank"], r["item_id"], r["score"]) for r in hits if r["query_id"] == qid)
        want = brute_bm25(DOCS, text, {1: 2.0, 2: 1.0})[:3]
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[1] for w in want], abs=1e-5)


def test_bm25_filter_keeps_statistics(spark):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    queries = spark.createDataFrame([(1, "kinase")], "qid int, q string")
    args = (docs, "id", {"body": "body"}, queries, "qid", "q", 5)
    everything = {r["item_id"]: r["score"] for r in bm25_topk(*args).collect()}
    some = {r["item_id"]: r["score"] for r in bm25_topk(*args, matching=docs.filter("id > 3")).collect()}
    assert some == {k: v for k, v in everything.items() if k > 3}


@pytest.mark.parametrize("block", [1024, 7])
def test_knn_brute_force(spark, block):
    rng = np.random.default_rng(5)
    items, queries = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    items[17] = items[3]
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id int, embedding array<float>")
    query_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<float>")
    hits = topk.scored_topk(item_df, query_df, vectors.cosine_scorer, 5, block).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(items.astype("f4").astype(float)) @ unit(queries.astype("f4").astype(float)).T, 6)
    for q in range(20):
        want = sorted(range(300), key=lambda i: (-scores[i, q], i))[:5]
        got = sorted((r["rank"], r["item_id"]) for r in hits if r["query_id"] == q)
        assert [g[1] for g in got] == want


def test_knn_cells(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8)) * 5
    data = [centres[i % 6] + rng.normal(size=8) * 0.2 for i in range(300)]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item_id int, embedding array<float>")
    queries = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "query_id int, embedding array<float>")
    index = vectors.build_cells(items, 6)
    key = lambda r: (r["query_id"], r["rank"], r["item_id"])
    exact = sorted(map(key, vectors.knn_cosine(items, queries, 5).collect()))
    assert sorted(map(key, vectors.knn_cells(index, queries, 5, probes=6).collect())) == exact
    near = sorted(map(key, vectors.knn_cells(index, queries, 5, probes=2).collect()))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)
    assert index.items.count() == 300


def test_knn_without_queries_or_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "item_id int, embedding array<float>")
    none = spark.createDataFrame([(1, None)], "query_id int, embedding array<float>")
    some = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert vectors.knn_cosine(items, none, 3).count() == 0
    assert [tuple(r) for r in vectors.knn_cosine(items, some, 3).collect()] == [(1, 1, 1.0, 1)]


def test_hashed_embedding_is_unit(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "a b a")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in vectors.hashed_embedding(df, F.col("t"), 16).collect()}
    assert got[1] == got[3] and sum(x * x for x in got[1]) == pytest.approx(1.0)
    assert sum(got[2]) == 0 and len(got[2]) == 16


def test_pluggable_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    out = vectors.encoded_embedding(df, F.col("t"), lambda: lambda texts: np.array([[len(t), 0.0] for t in texts]))
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


EVIDENCE = [
    (1, "Gefitinib", "T1", "EGFR", "kinase inhibition", "IC50", 2.0, 8.7, 9),
    (2, "Erlotinib", "T1", "EGFR", "kinase inhibition", "IC50", 2.0, 8.7, 9),
    (3, "Lapatinib", "T2", "HER2", "cell proliferation", "Ki", 30.0, 7.5, 8),
    (4, None, "T2", "HER2", None, "IC50", 900.0, 6.0, 7),
]
EVIDENCE_SCHEMA = (
    "activity_id int, compound_name string, target_chembl_id string, target_name string, assay_description string, "
    "standard_type string, standard_value_nm double, pchembl_value double, confidence_score int"
)


@pytest.mark.parametrize(
    "args, ids",
    [
        ({}, [1, 2, 3, 4]),
        ({"query": "KINASE lapatinib"}, [1, 2, 3]),
        ({"target": "known"}, [3, 4]),
        ({"target": "egfr"}, [1, 2]),
        ({"standard_type": "IC50", "max_value_nm": 2}, [1, 2]),
        ({"min_confidence": 8, "limit": 1}, [1]),
        ({"limit": 999}, [1, 2, 3, 4]),
        ({"query": "absent"}, []),
    ],
)
def test_search_evidence(spark, args, ids):
    df = spark.createDataFrame(EVIDENCE, EVIDENCE_SCHEMA)
    hits = search.search_evidence(df, resolve={"known": "T2"}.get, **args)
    assert [r["activity_id"] for r in hits.collect()] == ids


def test_bool_should_and_terms(spark):
    df = spark.createDataFrame(EVIDENCE, EVIDENCE_SCHEMA)
    wanted = search.bool_query(
        should=[F.col("activity_id") == 1, F.col("target_name") == "HER2", F.col("activity_id") == 3],
        minimum_should_match=2,
    )
    assert [r["activity_id"] for r in df.filter(wanted).collect()] == [3]
    counts = search.terms_aggregation(df, "target_chembl_id", 1).collect()
    assert [tuple(r) for r in counts] == [("T1", 2)]


# ----------------------------------------------------------------------- lookups


@pytest.mark.parametrize(
    "name, expected",
    [("EGFR", "CHEMBL203"), (" her2 ", "CHEMBL1824"), ("chembl99", "CHEMBL99"), ("nobody", None), ("", None), (None, None)],
)
def test_resolve_name_both_ways(spark, name, expected):
    assert resolve_name(name) == expected
    df = spark.createDataFrame([(name,)], "n string")
    assert resolve_names(df, "n", alias_table(spark)).first()["resolved_id"] == expected


# every key with blanks for underscores, every alias with noise around it, and two unknown names
TERMS = [(key.upper().replace("_", " "), entry[0]) for key, entry in GLOSSARY.items()]
TERMS += [(f" {alias}?", GLOSSARY[key][0]) for alias, key in GLOSSARY_ALIASES.items()]
TERMS += [("half life", None), (None, None)]


@pytest.mark.parametrize("name, term", TERMS)
def test_glossary(spark, name, term):
    df = spark.createDataFrame([(name,)], "n string")
    row = define_terms(df, "n", glossary_table(spark)).first()
    assert row["term"] == term
    assert (row["available"] is None) == (term is not None)
    if term:
        assert row["definition"] and row["direction"]


def test_embedding_counts_few_texts_at_a_time(monkeypatch):
    """However many texts an Arrow batch holds, a matrix has ``MATRIX_ROWS`` rows at most; vectors are the same."""
    buckets = [None if i % 9 == 0 else [i % 5, 1, (3 * i) % 8] * (i % 4) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(buckets, pa.list_(pa.int32()))], ["id", "e"])
    at_once = [row for b in vectors.bag_vectors([batch], "e", 8) for row in b.to_pylist()]
    monkeypatch.setattr(vectors, "MATRIX_ROWS", 4)
    parts = list(vectors.bag_vectors([batch], "e", 8))
    assert max(b.num_rows for b in parts) == 4
    assert [row for b in parts for row in b.to_pylist()] == at_once
    for row, have in zip(at_once, buckets):
        counts = np.bincount(have or [], minlength=8)
        assert row["e"] == pytest.approx(list(counts / (np.linalg.norm(counts) or 1)), abs=1e-6)
