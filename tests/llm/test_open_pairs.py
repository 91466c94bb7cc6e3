"""Pairs past a leader: no link may be lost, whatever the order of shingles and however crowded a passage is."""

from __future__ import annotations

import random

import pytest

from gaugeworks.llm import prob_minhash

SCHEMA = (
    "lead long, doc_id long, label long, similarity double, size long, "
    "added array<long>, removed array<long>"
)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b))


def _members(spark, leader: set, texts: dict[int, set], label: dict[int, int]):
    rows = [
        (0, d, label[d], _jaccard(leader, t), len(t), sorted(t - leader), sorted(leader - t))
        for d, t in texts.items()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _family(rng: random.Random, of: set, edits: int) -> set:
    kept = set(rng.sample(sorted(of), max(1, len(of) - edits)))
    return kept | {rng.getrandbits(32) for _ in range(rng.randint(0, edits))}


def _texts(rng: random.Random, leader: set) -> dict[int, set]:
    """Families at many distances from the leader; a passage that is in most texts beside it."""
    passage = {rng.getrandbits(32) for _ in range(30)}
    texts = {}
    for _ in range(12):
        far = _family(rng, leader, rng.choice([5, 20, 45, 60])) | (passage if rng.random() < 0.7 else set())
        for _ in range(5):
            texts[len(texts) + 1] = _family(rng, far, rng.choice([2, 8, 15]))
    return texts


@pytest.mark.parametrize("slots", [prob_minhash.ORDER_SLOTS, 1, 7])
def test_no_link_between_texts_of_a_leader_is_lost(spark, monkeypatch, slots):
    monkeypatch.setattr(prob_minhash, "ORDER_SLOTS", slots)
    rng = random.Random(slots)
    leader = {rng.getrandbits(32) for _ in range(60)}
    texts = _texts(rng, leader)
    label = {d: d if rng.random() < 0.8 else 1 for d in texts}
    got = {tuple(r) for r in prob_minhash._open_pairs(_members(spark, leader, texts, label), 0.8).collect()}
    near = {d for d, t in texts.items() if _jaccard(leader, t) >= 0.8}
    links = {
        (a, b)
        for a in texts
        for b in texts
        if a < b and label[a] != label[b] and not {a, b} <= near and _jaccard(texts[a], texts[b]) >= 0.8
    }
    assert links
    assert links <= got
    assert all(a < b and label[a] != label[b] for a, b in got)


def test_texts_that_share_one_passage_alone_are_no_candidates(spark):
    rng = random.Random(5)
    passage = [rng.getrandbits(32) for _ in range(40)]
    texts = {d: {*passage, *(rng.getrandbits(32) for _ in range(120))} for d in range(1, 60)}
    members = _members(spark, {rng.getrandbits(32) for _ in range(50)}, texts, {d: d for d in texts})
    assert prob_minhash._open_pairs(members, 0.8).count() == 0


def test_no_members_no_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prob_minhash._open_pairs(empty, 0.8).count() == 0
