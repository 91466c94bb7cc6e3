"""The pipeline stage by stage against brute force on a small corpus, and its run as a whole."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from gaugeworks.llm import packing
from tests.llm.test_operators import SCHEMA, prose


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    good = [prose(90, 500 + i) for i in range(60)]
    bad = [" ".join(f"{w}$$$" for w in t.split()) for t in good]
    copies = [good[0], good[0].replace(" ", "\t", 5), good[1]]
    near = [f"{good[2]} new{i}" for i in range(4)]
    texts = good + bad + copies + near + [None, "", "short"]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], 7, True, "x", 1) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}


def test_stages_against_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/stage{n}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append([r.doc_id for r in docs.select("doc_id").collect()])
    quality, exact, near, mixed = results

    clean = [i for i in rows if i < 60 or 120 <= i < 127]
    assert sorted(quality) == clean
    first = {}
    for i in clean:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i][1]), i)
    assert sorted(exact) == sorted(first.values())
    alone = []
    for i in sorted(exact):
        mine = shingles(rows[i][1])
        if all(len(mine & s) < 0.8 * len(mine | s) for s in (shingles(rows[k][1]) for k in alone)):
            alone.append(i)
    assert sorted(near) == alone

    sizes = collections.Counter()
    for i in alone:
        sizes[rows[i][3]] += len(rows[i][1].split())
    total = sum(sizes.values())
    taken, times = collections.Counter(), collections.Counter(mixed)
    for i, n in times.items():
        assert n <= 3
        taken[rows[i][3]] += n * len(rows[i][1].split())
    for source, weight in (("a", 5), ("b", 2), (None, 1)):
        assert taken[source] == pytest.approx(total * weight / 8, abs=95)

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: len(tokenizer.encode(rows[i][1], add_special_tokens=False).ids) + 1 for i in times}
    held = pieces.groupby("doc_id")["length"].sum()
    assert {i: times[i] * ids[i] for i in times} == {int(i): int(n) for i, n in held.items()}
    ordered = pieces.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id")["length"].cumsum()
    assert (ordered["offset"] == ends - ordered["length"]).all() and ends.max() <= 4096


def test_the_whole_run_gives_the_same_rows_twice(spark, corpus):
    folder, _ = corpus
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    first, second = (
        np.sort(corpus_pipeline.run(spark, folder).select(*columns).toPandas().to_records(index=False)) for _ in range(2)
    )
    assert len(first) and (first == second).all()
