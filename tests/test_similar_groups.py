import itertools

import numpy as np
import pytest

from gaugeworks.operators import graph


def brute(sets, least):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and shared / union >= least:
            out[a, b] = (shared, np.floor(shared / union * 10**4 + 0.5) / 10**4)
    return out


def frame(spark, sets):
    rows = [(g, m) for g, members in sets.items() for m in members]
    return spark.createDataFrame([*rows, *rows[:50], (None, 1), (1, None)], "grp int, member long")


def found(df):
    return {(r["group_a"], r["group_b"]): (r["shared"], r["jaccard"]) for r in df.collect()}


def families(seed, count=30, size=60):
    """Families of related sets around a hot member that all of them hold."""
    rng = np.random.default_rng(seed)
    sets = {}
    for f in range(count):
        core = set(rng.integers(1, 10**6, size).tolist())
        for _ in range(4):
            lost = set(rng.choice(sorted(core), rng.integers(0, size // 2), replace=False).tolist())
            sets[len(sets)] = (core - lost) | set(rng.integers(1, 10**6, rng.integers(0, 15)).tolist()) | {0}
    return sets


def test_pairs_are_exact_and_few_are_missed(spark):
    sets = families(1)
    for least, recall in ((0.5, 0.999), (0.25, 0.9)):
        want, got = brute(sets, least), found(graph.similar_groups(frame(spark, sets), "member", "grp", least))
        assert len(want) > 40 and got.items() <= want.items() and len(got) >= recall * len(want)


def test_equal_sets_and_single_members(spark):
    sets = {1: {7}, 2: {7}, 3: {7, 8}, 4: {9}, 5: {8, 7}}
    assert found(graph.similar_groups(frame(spark, sets), "member", "grp", 0.5)) == brute(sets, 0.5)
    assert graph.similar_groups(frame(spark, sets).limit(0), "member", "grp", 0.5).count() == 0
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            graph.similar_groups(frame(spark, sets), "member", "grp", bad)


@pytest.mark.parametrize(("light", "block"), [(64, 1024), (1, 2), (2, 3), (5, 1)])
def test_shared_members_on_both_routes(spark, light, block):
    sets = families(2, count=4, size=12)
    pairs = graph.memberships(frame(spark, sets), "member", "grp")
    got = {(r["group_a"], r["group_b"]): r["shared"] for r in graph.shared_members(pairs, light, block).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert got == want
