"""Classes of words: all training words are tried in all classes, however few travel or are exchanged in turn."""

import collections

import numpy as np
import pytest

from gaugeworks.llm import brown_lm


def likelihood(steps):
    return brown_lm._plogp(steps).sum() - 2 * brown_lm._plogp(steps.sum(axis=1)).sum()


def test_best_classes_raise_the_likelihood_most():
    """Against the likelihood of all class bigrams, counted anew for every class a word is tried in."""
    rng = np.random.default_rng(3)
    words, classes = 30, 6
    told = np.r_[words, rng.integers(0, words, 900), words]
    told[rng.integers(1, 900, 40)] = words
    told[100:110] = 7
    old = np.r_[np.arange(words) % classes, classes]

    def counted(of):
        steps = np.zeros((classes + 1, classes + 1))
        np.add.at(steps, (of[told[:-1]], of[told[1:]]), 1)
        return steps

    seen = np.zeros((words, 2, classes + 1))
    own = np.zeros(words)
    for a, b in zip(told[:-1], told[1:], strict=True):
        if a == b and a < words:
            own[a] += 1
            continue
        if a < words:
            seen[a, 0, old[b]] += 1
        if b < words:
            seen[b, 1, old[a]] += 1
    got = brown_lm.best_classes(counted(old), seen[:, 0], seen[:, 1], own, old[:words])
    for w in range(words):
        tried = [likelihood(counted(np.where(np.arange(words + 1) == w, c, old))) for c in range(classes)]
        assert tried[got[w]] == pytest.approx(max(tried), abs=1e-6)


def corpus(spark):
    rng = np.random.default_rng(8)
    nouns, verbs = [f"n{i}x" for i in range(40)], [f"v{i}x" for i in range(40)]
    often = np.r_[np.full(20, 4), np.full(20, 1)] / 100
    texts = [" ".join(f"the {rng.choice(nouns, p=often)} will {rng.choice(verbs, p=often)}" for _ in range(30)) for _ in range(60)]
    return spark.createDataFrame([*enumerate(texts), (90, None), (91, "the unseen will word")], "doc_id long, text string")


def test_words_outside_the_vocabulary_get_the_class_of_their_contexts(spark):
    """Nouns and verbs have the same endings, so a class by the ending could not tell them apart."""
    docs = corpus(spark)
    found = brown_lm.fit(docs, vocabulary=42, classes=4)
    got = {r.word.decode(): (r["class"], r.n) for r in brown_lm.placed(docs, found).collect()}
    counts = collections.Counter(w for r in docs.collect() for w in (r.text or "").split())
    assert {w: n for w, (_, n) in got.items()} == {w: n for w, n in counts.items() if w.encode() not in found.classes}
    kinds = {kind: {c for w, (c, _) in got.items() if w[0] == kind and w[-1] == "x"} for kind in "nv"}
    assert kinds["n"] and kinds["v"] and not kinds["n"] & kinds["v"]


def test_contexts_of_a_word_may_span_batches(spark):
    docs = corpus(spark)
    found = brown_lm.fit(docs, vocabulary=2, classes=2)
    want = sorted(tuple(r) for r in brown_lm.placed(docs, found).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tuple(r) for r in brown_lm.placed(docs, found).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("head", [0, 20])
def test_scores_do_not_depend_on_the_words_that_travel(spark, head):
    docs = corpus(spark)
    want = {r.doc_id: r for r in brown_lm.score_documents(docs, vocabulary=2).collect()}
    got = {r.doc_id: r for r in brown_lm.score_documents(docs, vocabulary=2, head_words=head).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_known, r.n_tokens) == (want[i].n_known, want[i].n_tokens)
        assert r.score == pytest.approx(want[i].score) and r.base_score == pytest.approx(want[i].base_score)
