"""Segmentation against all splits, verdicts against plain Python, ownership against counting by hand."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import secrets, url_filter

PAGES = "page_id long, url string, html string, host string, rule string, words string"


def pages(spark, urls, html="<p>x</p>"):
    return spark.createDataFrame([(i, u, html if isinstance(html, str) else html[i], "h", "r", "w") for i, u in enumerate(urls)], PAGES)


def all_splits(name):
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(name)]
        yield list(zip([0, *ends[:-1]], ends))


def brute_own(spans, own):
    """Words that no cover by two or more own words explains."""
    kept = {}
    for (s, e), p in sorted(spans.items(), key=lambda x: (x[0][1] - x[0][0], x[0])):
        covers = [sum(kept[s + a, s + b] for a, b in split) for split in all_splits("x" * (e - s)) if all((s + a, s + b) in kept for a, b in split)]
        if p - max(covers, default=-math.inf) >= math.log(own):
            kept[s, e] = p
    return kept


@pytest.mark.parametrize("own", [1.0, 1000.0])
def test_segments_are_the_best_of_all_splits(own):
    rng = np.random.default_rng(3)
    for _ in range(150):
        name = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        parts = list(url_filter._inside(name))
        words = {t: float(-rng.uniform(1, 20)) for _, t in parts if rng.random() < 0.4}
        spans = {(s, s + len(t)): words[t] for s, t in parts if t in words}
        kept = brute_own(spans, own)
        cost = lambda split: sum(kept.get((a, b), url_filter.STRANGE if b - a == 1 else -math.inf) for a, b in split)
        best = max(map(cost, all_splits(name)))
        got, at = [], 0
        for piece in url_filter.segment(name, spans, own):
            if (at, at + len(piece)) in kept:
                got.append((at, at + len(piece)))
            else:
                got += [(i, i + 1) for i in range(at, at + len(piece))]
            at += len(piece)
        assert at == len(name) and cost(got) == pytest.approx(best)


def test_glued_names_are_split(spark):
    text = "<p>" + "bad " * 50 + "site " * 50 + "badsite " * 100 + "html cat " * 40 + "</p>"
    found = pages(spark, ["http://badsite.org/htmlcat"], text)
    got = url_filter.judge(found, url_filter.fit(found)).first()
    assert got["words"] == "h:bad h:site h:org p:html p:cat"
    whole = url_filter.judge(found, url_filter.fit(found, own=1e-9), own=1e-9).first()
    assert whole["words"].startswith("h:badsite ")


URLS = [
    "http://A.Example.net/en/1?x", "https://b.net/y", "http://x.example.com/de", "http://badsite.info/spam42", None, "nothing",
    "http://net", "http://b.net/y", "ftp://", "http://goodcat.org/fr/cat", "http://x.org/" + "spam" * 300, "http://goodsite.org/fr/good",
]


def brute_judge(urls, html, rules=url_filter.RULES):
    counts = collections.Counter()
    for page in html:
        counts.update(re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", page).lower()))
    counts = {w: n for w, n in counts.items() if 2 <= len(w) <= url_filter.LONGEST}
    total = sum(counts.values())

    def tokens(host, path):
        out = []
        for kind, text in (("h", host), ("p", path)):
            for name in re.findall(r"[^\W\d_]+|\d+", text.lower()):
                if name.isdigit():
                    out.append(f"{kind}:#{min(9, len(name))}")
                else:
                    spans = {(s, s + len(t)): math.log(counts[t] / total) for s, t in url_filter._inside(name) if t in counts}
                    out += [f"{kind}:{w}" for w in url_filter.segment(name, spans)]
        return out

    parts, taught = [], collections.defaultdict(collections.Counter)
    n_urls = collections.Counter()
    for url in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=lambda r: len(r[0]), default=(None, None))
        parts.append((host, path, rule, tokens(host, path)))
        if rule[1]:
            taught[rule[1]].update(parts[-1][3])
            n_urls[rule[1]] += 1
    kinds = len({*taught["allow"], *taught["block"]})
    sums = {v: sum(taught[v].values()) for v in ("allow", "block")}
    prior = math.log(n_urls["block"] + 1) - math.log(n_urls["allow"] + 1)
    out = []
    for host, path, rule, found in parts:
        odds = prior
        for t in found:
            if taught["allow"][t] + taught["block"][t]:
                odds += math.log((taught["block"][t] + 1) / (sums["block"] + kinds)) - math.log((taught["allow"][t] + 1) / (sums["allow"] + kinds))
        out.append((host, path, rule[0], rule[1] or ("block" if round(odds, 9) > 0 else "allow"), round(odds, 6), " ".join(found)))
    return out


@pytest.mark.parametrize("head", [0, 3, 50_000])
def test_verdicts_do_not_depend_on_what_travels(spark, head):
    html = ["<p>bad site spam</p> good cat cat cat", "<b>spam</b> goodcat", "", *["spam good site"] * 9]
    found = pages(spark, URLS, html)
    model = url_filter.fit(found, head_words=head)
    got = sorted(url_filter.judge(found, model, head_names=head).collect(), key=lambda r: r["page_id"])
    want = brute_judge(URLS, html)
    assert [(r["host"], r["path"], r["rule"], r["verdict"], round(r["log_odds"], 6), r["words"]) for r in got] == want


def test_urls_of_an_empty_table_and_repeated_rows(spark):
    found = pages(spark, URLS)
    none = found.limit(0)
    assert url_filter.judge(none, url_filter.fit(none)).count() == 0
    twice = found.union(found).withColumn("page_id", F.lit(None).cast("long"))
    assert url_filter.judge(twice, url_filter.fit(twice)).count() == 2 * len(URLS)
    alone = url_filter.judge(found, url_filter.fit(none)).collect()
    assert {r["verdict"] for r in alone if r["rule"] is None} == {"allow"}


SCHEMA = "doc_id long, text string, source string, owner string, row string, base string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "o", "r", "b") for i, (t, s) in enumerate(rows)], SCHEMA)


def test_every_value_is_told_its_counts(spark):
    live, copied, shared = "aZ3" + "kQ9" * 7, "bY4" + "mP8" * 7, "token=abcdefgh"
    rows = [(f"x {live}", "a")] * 30 + [(f"{i} {copied}", "a") for i in range(12)]
    rows += [(f"{i} {shared}", "ab"[i % 2]) for i in range(4)] + [("secret: onlyhere", None), (None, "a"), ("", None)]
    rows += [("see ftp://me:pass-w0rd@host/x", "b"), (f"eyJ{'a' * 9}.eyJ{'b' * 9}.{'c' * 9}", "b")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, rows)).collect()}
    told = {i: [(s["kind"], s["owners"], s["repositories"], s["live"]) for s in r["told"]] for i, r in got.items()}
    assert all(told[i] == [("key", 1, 1, True)] for i in range(30)), "exact copies are one repository"
    assert all(told[i] == [] and got[i]["added"] == [] for i in range(30, 42)), "copied candidates add nothing"
    assert all(told[i] == [("assign", 2, 4, False)] for i in range(42, 46)), "base spans stay, told as copied"
    assert told[46] == [("assign", 1, 1, True)] and told[47] == told[48] == []
    (url,) = got[49]["added"]
    assert (url["kind"], rows[49][0][url["start"] : url["end"]]) == ("url", "ftp://me:pass-w0rd@")
    assert [s["kind"] for s in got[50]["added"]] == ["signed"]
    assert got[0]["added"][0]["value"] == live


def test_positions_in_a_long_log(spark):
    lines = [f"é{i} token={i:08d} password: {'x' * (i % 9)}" for i in range(4000)]
    text = "\n".join(lines)
    got = secrets.find_secrets(docs(spark, [(text, "a")])).first()
    pattern = re.compile(secrets.KINDS[0][1])
    want = [(m.start(), m.end()) for m in pattern.finditer(text) if len(m[1]) >= 6]
    assert [(s["start"], s["end"]) for s in got["base"] if s["kind"] == "assign"] == want and len(want) > 4000
    assert len(got["told"]) == len(got["base"]) + len(got["added"])


def test_repeated_ids_and_null_owners(spark):
    rows = spark.createDataFrame([(None, "token=abcdefgh", None)] * 3 + [(1, "token=abcdefgh", "a")], "doc_id long, text string, source string")
    got = secrets.find_secrets(rows).collect()
    assert len(got) == 4 and {(s["owners"], s["repositories"]) for r in got for s in r["told"]} == {(2, 2)}
    assert secrets.find_secrets(rows.limit(0)).count() == 0
