"""Operators against brute force on small tables with nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import (
    brown_lm,
    exact_dedup,
    language_gru,
    mixing,
    packing,
    prob_minhash,
    quality_rules,
    secrets,
    suffix_dedup,
    url_filter,
)
from gaugeworks.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, size long, kept boolean, row string, key int"
rng = np.random.default_rng(4)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", None, "b"])[i % len(sources or "abc")], 7, True, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


BASE = prose(120, 1)
TEXTS = [
    BASE, BASE, BASE.replace(" ", "\t\n", 3), None, "", "  ", prose(60, 2) + " " + BASE, prose(3, 3), prose(3, 3), prose(5000, 5),
    BASE + " " + prose(4, 6), prose(4, 7) + " " + BASE, "é" * 30 + prose(20, 8), "é" * 30 + prose(20, 8)[:60], prose(80, 9) * 2,
]


def test_components_of_a_chain_and_a_star(spark, rows):
    links = [(i, i + 1) for i in range(20, 40)] + [(1, k) for k in range(2, 9)]
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert all(found[k] == 20 for k in range(20, 41)) and all(found[k] == 1 for k in range(1, 9))


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, rows, bits):
    got = rows(exact_dedup.exact_groups(table(spark, TEXTS), key_bits=bits, capacity=3))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    want = []
    for i, t in enumerate(norm):
        same = [k for k, u in enumerate(norm) if u == t]
        want.append((i, same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(got) == want
    kept = exact_dedup.drop_copies(table(spark, TEXTS))
    assert kept.columns == table(spark, TEXTS).columns
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[3]]


def test_directory_splits_until_no_bucket_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    directory = exact_dedup.split_directory(keys, capacity=100)
    assert directory.agg(F.max("entries")).first()[0] <= 100
    assert directory.agg(F.sum("entries"), F.sum(F.expr("power(2.0, -depth)"))).first()[0] == 3000


def test_targets_and_mix(spark):
    texts = [prose(n, n) for n in range(1, 181)] + [None, ""]
    docs = table(spark, texts, ["a", "b", None])
    mix = mixing.plan_mix(docs, shard_words=2000)
    got = {r.doc_id: r for r in mixing.taken_words(mix).collect()}
    assert len(got) == len(texts) and all(r.taken <= 3 * r["size"] for r in got.values())
    sizes = collections.Counter()
    for i in got:
        sizes[i % 3] += got[i]["size"]
    total = sum(sizes.values())
    for s, weight in enumerate((5, 2, 1)):
        target = next(r.target for i, r in got.items() if i % 3 == s)
        assert target == pytest.approx(total * weight / 8)
        assert sum(r.taken for i, r in got.items() if i % 3 == s) == pytest.approx(target, rel=0.02)
    rows_out = mixing.mixed(docs, mix)
    times = collections.Counter(r.doc_id for r in rows_out.collect())
    assert rows_out.columns == docs.columns
    assert all(times[i] * r["size"] == r.taken for i, r in got.items())
    quotas = mix.draws.groupBy("shard").count().toPandas()["count"]
    assert quotas.sum() == mix.draws.count() and quotas.max() - quotas.min() <= 1


def test_hypergeometric_follows_its_distribution(spark):
    draws = spark.range(4000).select(
        mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 4000).alias("x")
    )
    mean, variance = draws.agg(F.avg("x"), F.var_pop("x")).first()
    assert mean == pytest.approx(4.0, abs=0.02) and variance == pytest.approx(10 * 0.4 * 0.6 * 40 / 49, rel=0.02)


def test_secrets(spark):
    live = "aZ3" + "kQ9" * 7
    shared = "bY4" + "mP8" * 7
    texts = [f"x password: s3cretvalue {live} {shared}", f"é token=abc AKIA{'A1' * 9} {shared}", None, "", f"{'0a' * 14} {shared}"]
    got = {r.doc_id: r for r in secrets.find_secrets(table(spark, texts, ["a", "b", "c"])).collect()}
    spans = {i: [(s["kind"], s["start"], s["end"]) for s in [*r.base, *r.added]] for i, r in got.items()}
    assert spans[0] == [("assign", 2, 23), ("key", 24, 24 + len(live))]
    assert spans[1] == [("access", 12, 34)]
    assert spans[2] == spans[3] == [] and spans[4] == [("hex", 0, 28)]


def test_a_value_in_many_documents_of_one_owner_is_copied(spark):
    copied, live = "cX5" + "nR7" * 7, "dW6" + "oS4" * 7
    texts = [f"{i} {copied}" for i in range(11)] + [f"{i} {live}" for i in range(10)]
    got = {r.doc_id: len(r.added) for r in secrets.find_secrets(table(spark, texts, ["a"])).collect()}
    assert got == {i: int(i >= 11) for i in range(21)}


def test_rules_are_learned_and_measured(spark):
    good = [prose(90, 100 + i) for i in range(60)]
    bad = [" ".join(f"{w}$$$" for w in t.split()) for t in good]
    docs = table(spark, good + bad + [None, "", "short"])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert rules
    got = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 123))
    kept = quality_rules.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == 60
    assert quality_rules.fit(docs, labels.limit(0)) == []


def test_packing_round_trip(spark):
    pieces = packing.tokenise(table(spark, TEXTS), packing.default_tokenizer(), window=256).cache()
    packed = packing.pack(pieces, window=256)
    out = packed.toPandas().sort_values(["sequence_id", "offset"])
    ends = out.groupby("sequence_id")["length"].cumsum()
    assert (out["offset"] == ends - out["length"]).all() and ends.max() <= 256
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed, pieces).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        mine = out[out["doc_id"] == i].sort_values("start")
        joined = [x for p in mine.itertuples() for x in whole[p.sequence_id][p.offset : p.offset + p.length]]
        assert joined == ids
    lengths = np.array(sorted([200, 56, 100, 156, 30, 226], reverse=True))
    sequence, _ = packing.best_fit(lengths, 256)
    assert sequence.max() == 2


def test_suffix_dedup(spark):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, TEXTS)).collect()}
    seen = set()
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        mask = bytearray(len(raw))
        for k, w in enumerate(windows):
            if w in seen:
                mask[k : k + 50] = b"\1" * 50
        seen.update(windows)
        runs = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        kept = bytes(x for x, gone in zip(raw, mask, strict=True) if not gone)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(mask), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_with_hot_anchors(spark, monkeypatch):
    line = prose(12, 44)
    texts = [f"{prose(12, 500 + i)} {line} {prose(12, 700 + i)}" for i in range(60)]
    docs = table(spark, [*TEXTS, *texts])
    runs = lambda: sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    ranges = []

    def sorted_range(group):
        parts = [suffix_dedup._unpack(p) for p in group["payload"] if p]
        return collections.Counter(int(g) for p in parts for g in p["gram"])

    cold = runs()
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    assert runs() == cold
    raw = [t.encode() for t in texts]
    plain = docs.filter(F.col("doc_id") >= len(TEXTS)).withColumn("part", F.lit(0))
    hot = suffix_dedup.hot_grams(plain)
    assert len(hot) >= 2
    for known in (hot[:0], hot):
        batch = plain.select("doc_id", "part", "text").toPandas()
        batch["grams"] = [[np.unique(suffix_dedup.anchors([r])[1]).tobytes()] for r in raw]
        sent = [f for f in suffix_dedup._contexts(64, known)(iter([batch])) if f["payload"].str.len().any()]
        owners = [sorted_range(g) for f in sent for _, g in f.groupby("range")]
        ranges.append([sum(int(h) in o for o in owners) for h in hot])
    assert max(ranges[0]) == 1 and max(ranges[1]) > 30


def test_suffix_dedup_with_repeated_ids(spark):
    line, own = prose(12, 40), prose(30, 41)
    rows = [(1, line), (2, f"{own} {line}"), (2, f"{own} {line}"), (2, f"{prose(50, 42)} {line} x"), (3, f"{line} {own}"), (3, prose(40, 43))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    want = []
    for i, text in rows:
        raw = text.encode()
        others = b"\0".join(t.encode() for j, t in rows if j < i)
        mask = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in others:
                mask[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        kept = bytes(x for x, gone in zip(raw, mask, strict=True) if not gone)
        want.append((i, len(raw), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_near_classes(spark):
    edited = [BASE.split() for _ in range(30)]
    for i, words in enumerate(edited):
        for k in np.random.default_rng(i).choice(len(words), i % 5, replace=False):
            words[k] = f"new{i}{k}"
    texts = [*TEXTS, *(" ".join(w) for w in edited)]
    got = {r.doc_id: r.class_id for r in prob_minhash.near_classes(table(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {i: find(i) for i in range(len(texts))}
    kept = prob_minhash.keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_near_copies_with_a_line_repeated(spark):
    texts = []
    for i in range(20):
        lines = [prose(14, 1000 + 30 * i + k) for k in range(21)]
        texts += ["\n".join(lines), "\n".join([*lines, *[lines[-1]] * 60])]
    got = {r.doc_id: r.class_id for r in prob_minhash.near_classes(table(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_language(spark):
    alphabets = {"aa": "abcde", "bb": "vwxyz"}
    rows, n = [], 0
    for lang, letters in alphabets.items():
        for _ in range(40):
            text = " ".join("".join(np.random.default_rng(n).choice(list(letters), 4)) for _ in range(40))
            rows.append((n, text, lang))
            n += 1
    rows += [(n, None, "aa"), (n + 1, "12 !", None), (None, "abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_gru.identify(docs, language_gru.fit(docs)).collect()
    truth = {r[0]: r for r in rows}
    assert all(r.lang_pred == truth[r.doc_id][2] for r in out if r.doc_id is not None and r.doc_id < n)
    assert {r.lang_pred for r in out if r.doc_id in (n, n + 1)} == {"und"}


def test_class_model_scores(spark):
    texts = [prose(40, 300 + i).upper() if i % 3 else prose(40, 300 + i) for i in range(30)] + [None, ""]
    got = {r.doc_id: r for r in brown_lm.score_documents(table(spark, texts)).collect()}
    words = [(t or "").lower().split() for t in texts]
    taught = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for i in taught for w in words[i])
    counts[""] = len(taught)
    total, distinct = sum(counts.values()), len(counts)
    for i, w in enumerate(words):
        ps = [(counts[x] + 0.5) / (total + 0.5 * (distinct + 1)) for x in [*w, ""]]
        assert got[i].base_score == pytest.approx(np.log10(ps).sum())
        assert (got[i].n_tokens, got[i].n_known) == (len(w) + 1, sum(counts[x] > 0 for x in [*w, ""]))
        assert got[i].train_tokens == total and got[i].score < 0


def test_urls(spark):
    urls = ["http://A.Example.net/en/1?x", "https://b.net/y", "http://x.example.com/de", "http://badsite.info/spam", None, "nothing", "http://net"]
    pages = spark.createDataFrame([(i, u, "<p>bad site spam</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    model = url_filter.fit(pages)
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/", "block")
    assert got[2].rule is None and got[6].rule is None and (got[4].host, got[4].path) == ("", "")
    assert "h:bad h:site" in got[3].words and {r.verdict for r in got.values()} <= {"allow", "block"}


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_groups, suffix_dedup.remove_repeats, prob_minhash.near_classes, secrets.find_secrets,
     packing.pack_documents, brown_lm.score_documents, lambda d: mixing.taken_words(mixing.plan_mix(d)),
     lambda d: language_gru.identify(d, language_gru.fit(d)), lambda d: quality_rules.judge(d, [])],
)
def test_empty_tables(spark, operator):
    assert operator(table(spark, []).limit(0)).count() == 0


def test_suffix_order_compares_few_hashes():
    """Suffixes that differ in their first bytes are told apart without a hash; the order is that of the bytes."""
    rng = np.random.default_rng(4)
    data = np.r_[rng.integers(97, 100, 4000), np.full(300, 97), rng.integers(200, 256, 500)].astype(np.uint8)
    order = suffix_dedup.SuffixOrder(data)
    x, y = rng.integers(0, len(order.whole), 3000), rng.integers(0, len(order.whole), 3000)
    text = data.tobytes()
    cut = suffix_dedup.LENGTH
    calls, of = [], order.hashes.of
    order.hashes.of = lambda at, length: calls.append(len(at)) or of(at, length)
    for equal in (False, True):
        got = order.before(x, y, np.full(len(x), equal))
        want = [text[i : i + cut] < text[j : j + cut] or (equal and text[i : i + cut] == text[j : j + cut]) for i, j in zip(x, y)]
        assert got.tolist() == want
    assert sum(calls) < 2 * len(x)
