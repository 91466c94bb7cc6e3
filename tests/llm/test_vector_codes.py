"""Resident Lloyd against plain rounds over all vectors in integers."""

import hashlib
import math

import numpy as np
import pytest

from gaugeworks.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def brute_force(rows, rounds=6):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = dim // 8
    parts = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def assign(p):
        out = []
        for x in parts[p]:
            distances = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
            out.append((distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        for p in range(8):
            entries = [e for e, _ in assign(p)]
            for e in range(len(books[p])):
                members = [x for x, at in zip(parts[p], entries) if at == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    final = [assign(p) for p in range(8)]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    errors = [sum(final[p][n][1] for p in range(8)) for n in range(len(kept))]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return [
        (vec_id, label, "".join(f"{final[p][n][0]:02x}" for p in range(8)), errors[n], by_label[label], sha)
        for n, (vec_id, _, label) in enumerate(kept)
    ]


def run(spark, rows, schema=SCHEMA):
    got = vector_codes.compress(spark.createDataFrame(rows, schema))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_rows(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, 0.2, dim)], int(i) % 3) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed, n, dim", [(1, 300, 16), (2, 40, 24), (3, 5, 8)])
def test_equals_plain_rounds(spark, seed, n, dim):
    rows = random_rows(seed, n, dim)
    assert run(spark, rows) == sorted(brute_force(rows), key=str)


def test_edges(spark):
    rows = random_rows(4, 60)
    vector = rows[0][1]
    rows += [(7, vector, None), (7, vector, None), (7, rows[1][1], 2), (None, vector, 1), (None, rows[3][1], None)]
    rows += [(90 + i, vector, 5) for i in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] + vector[1:], 1), (203, [math.nan] + vector[1:], 1)]
    rows += [(204, [math.inf] + vector[1:], 1), (205, vector + [0.5], 1), (206, vector[:8], 1)]
    want = brute_force(rows)
    assert len(want) == 105 and run(spark, rows) == sorted(want, key=str)


def test_all_equal_and_negative(spark):
    rows = [(i, [-0.00001] * 8, 0) for i in range(30)]
    got = run(spark, rows)
    assert got == sorted(brute_force(rows), key=str) and {r[2] for r in got} == {"00" * 8} and {r[3] for r in got} == {0}


def test_empty_table_and_bad_sizes(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [0.5] * 9, 1)])
    with pytest.raises(Exception, match="or more in size"):
        run(spark, [(1, [1e9] * 8, 1)])


def test_clashing_columns_and_floats(spark):
    rows = random_rows(5, 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    extra = df.selectExpr("*", "'r' as row", "1 as pos", "2 as entry", "3 as error", "4 as code", "5 as x")
    floats = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted((tuple(r) for r in vector_codes.compress(extra).collect()), key=str) == sorted(brute_force(floats), key=str)


def test_only_movers_are_dealt_anew(spark, monkeypatch):
    """Members that keep their entry never pass the shuffle again, and every member is held once."""
    rows = spark.createDataFrame(random_rows(6, 400), SCHEMA)
    vectors = vector_codes.integer_vectors(rows)
    books = vector_codes.first_codebooks(vectors)
    sent = []
    deal = vector_codes.dealt

    def counted(members, n_vectors):
        sent.append(members.count())
        return deal(members, n_vectors)

    monkeypatch.setattr(vector_codes, "dealt", counted)
    books, members = vector_codes.lloyd(vectors, books, 400)
    assert sent[0] == 400 * 8 and all(later < sent[0] / 2 for later in sent[1:])
    held = members.select("row", "pos").collect()
    assert len(held) == len({tuple(h) for h in held}) == 400 * 8


def test_salts_split_a_hot_entry(spark):
    """Equal vectors share every entry; their members still lie with many owners."""
    n = 20_000
    rows = spark.range(n).selectExpr("id as vec_id", "array_repeat(0.25d, 8) as embedding", "1 as label")
    vectors = vector_codes.integer_vectors(rows)
    members = vector_codes.dealt(vector_codes.cut(vectors, vector_codes.first_codebooks(vectors)), n)
    sizes = [len(p) for p in members.select("row").rdd.glom().collect()]
    assert sum(sizes) == 8 * n and len(sizes) == 2 and max(sizes) < 0.7 * 8 * n


def test_registered_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = entry.queries()["op13_vector_codes"](spark, sf)
    want = [(r[0], r[2], r[3], r[4], r[5]) for r in brute_force(rows)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
