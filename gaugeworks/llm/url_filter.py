"""URL filter: longest rule first, else naive Bayes over segmented host and path words.

Host labels and path parts are often words written together. A unigram model of the words of
all page texts splits them by Viterbi search: the split of highest probability, where a letter
that no word covers costs a fixed penalty. As glued names stand in texts too, a word counts as
one of its own only if it is OWN times as frequent as its parts would be side by side. A
multinomial naive Bayes model of the resulting tokens is trained on the urls that a rule
decides, and judges the others.

Counts, dictionary and tokens are tables over all pages, without a cut. A name (a run of
letters in a host or path) is split and scored once, however many urls have it. The most
frequent words and names travel with the tasks, which saves work; all others are looked up
by a join on the word or name, with the same results.

A NULL url, or one without ``://``, has an empty host and path; the prior decides it. Repeated
rows and ids are judged each on their own; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import materialize

# The rules of the registered query, host and path with their verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Words and names that travel with the tasks. Results do not depend on them.
HEAD_WORDS = 50_000
HEAD_NAMES = 50_000
# A word has 2 to LONGEST letters.
SHORTEST, LONGEST = 2, 40
# How much more frequent than its parts side by side a word of its own is.
OWN = 1000.0
# Log probability of a letter that no word covers.
STRANGE = -14.0
FLUSH = 300_000
# Log odds are rounded, so that they do not depend on the order of sums.
DIGITS = 9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAG = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.S | re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_NAMES = re.compile(r"[^\W\d_]+|\d+")

Span = tuple[int, int]


@dataclass(frozen=True)
class Model:
    """words: (word, log_p). head: the most frequent of them. tokens: (token, odds) of block against allow. prior: of the classes."""

    words: DataFrame
    head: dict[str, float]
    tokens: DataFrame
    prior: float


def host(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), _PARTS, 2), F.lit(""))


def longest_rule(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host covers the url's and whose path begins the url's; else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): words of SHORTEST to LONGEST letters in all page texts, tags left out, lower-cased."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for page in batch["html"]:
                counts.update(_LETTERS.findall(_TAG.sub(" ", page or "").lower()))
                if len(counts) > FLUSH:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    found = pages.select(F.col(html).alias("html")).mapInPandas(run, "word string, n long")
    return found.filter(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": object, "n": "int64"})


def _best(start: int, end: int, words: dict[int, list[tuple[int, float]]], strange: float) -> tuple[float, list[Span]]:
    """The most probable cover of start..end by words, given by their start, and by single letters at ``strange`` each."""
    best, cut = [-math.inf] * (end - start + 1), [0] * (end - start + 1)
    best[0] = 0.0
    for at in range(start, end):
        here = best[at - start]
        if here == -math.inf:
            continue
        for upto, p in [(at + 1, strange), *words.get(at, ())]:
            if upto <= end and here + p > best[upto - start]:
                best[upto - start], cut[upto - start] = here + p, at
    if best[-1] == -math.inf:
        return -math.inf, []
    spans, at = [], end
    while at > start:
        spans.append((cut[at - start], at))
        at = cut[at - start]
    return best[-1], spans[::-1]


def own_words(spans: dict[Span, float], own: float = OWN) -> dict[int, list[tuple[int, float]]]:
    """By start, the (end, log probability) of words that their parts side by side do not explain, shortest first.

    All words inside a word lie in the same name, so the name's own spans decide.
    """
    kept: dict[int, list[tuple[int, float]]] = {}
    for start, end in sorted(spans, key=lambda s: (s[1] - s[0], s)):
        p = spans[start, end]
        if p - _best(start, end, kept, -math.inf)[0] >= math.log(own):
            kept.setdefault(start, []).append((end, p))
    return kept


def segment(name: str, spans: dict[Span, float], own: float = OWN) -> list[str]:
    """The most probable split of a name into words; runs of letters that no word covers stay together."""
    words = own_words(spans, own)
    out: list[str] = []
    strange = False
    for start, end in _best(0, len(name), words, STRANGE)[1]:
        odd = end - start == 1
        if odd and strange:
            out[-1] += name[start:end]
        else:
            out.append(name[start:end])
        strange = odd
    return out


def _inside(name: str) -> Iterator[tuple[int, str]]:
    """(start, text) of all parts of a name that may be a word."""
    for start in range(len(name) - SHORTEST + 1):
        for end in range(start + SHORTEST, min(len(name), start + LONGEST) + 1):
            yield start, name[start:end]


def split_names(names: DataFrame, model: Model, own: float = OWN) -> DataFrame:
    """(name, words) for distinct names in column ``name``. Digits become their number of places, nine at most."""
    head = model.head
    numbered = materialize(names.select(F.monotonically_increasing_id().alias("id"), "name"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[int, int, str]] = []
        for batch in batches:
            for key, name in zip(batch["id"], batch["name"], strict=True):
                for start, text in () if name.isdigit() else _inside(name):
                    if text not in head:
                        rows.append((key, start, text))
                    if len(rows) >= FLUSH:
                        yield pd.DataFrame(rows, columns=["id", "start", "word"])
                        rows = []
        yield pd.DataFrame(rows, columns=["id", "start", "word"]).astype({"id": "int64", "start": "int32", "word": object})

    found = numbered.mapInPandas(parts, "id long, start int, word string").join(model.words, "word")
    found = found.groupBy("id").agg(F.collect_list(F.struct("start", F.length("word").alias("size"), "log_p")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = []
            for name, rare in zip(batch["name"], batch["found"], strict=True):
                if name.isdigit():
                    split.append([f"#{min(len(name), 9)}"])
                    continue
                spans = {(start, start + len(t)): head[t] for start, t in _inside(name) if t in head}
                spans |= {(r["start"], r["start"] + r["size"]): r["log_p"] for r in (rare if rare is not None else ())}
                split.append(segment(name, spans, own))
            yield pd.DataFrame({"name": batch["name"], "words": split})

    joined = numbered.join(found, "id", "left").select("name", "found")
    return materialize(joined.mapInPandas(run, "name string, words array<string>"))


def _names(host: str, path: str) -> list[tuple[str, str]]:
    """(kind, name) in order: h from the host, p from the path."""
    return [(kind, name) for kind, text in (("h", host), ("p", path)) for name in _NAMES.findall(text.lower())]


def count_names(urls: DataFrame) -> DataFrame:
    """(kind, name, n, allow, block) over all urls (host, path, ruled); each task sums before it sends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, str, str]] = Counter()
        for batch in batches:
            for h, p, ruled in zip(batch["host"], batch["path"], batch["ruled"], strict=True):
                counts.update((kind, name, ruled or "") for kind, name in _names(h, p))
                if len(counts) > FLUSH:
                    yield table_of(counts)
                    counts = Counter()
        yield table_of(counts)

    def table_of(counts: Counter) -> pd.DataFrame:
        rows = [(*key, n) for key, n in counts.items()]
        return pd.DataFrame(rows, columns=["kind", "name", "ruled", "n"]).astype({"n": "int64"})

    counted = urls.select("host", "path", "ruled").mapInPandas(run, "kind string, name string, ruled string, n long")
    by = {v: F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")}
    return counted.groupBy("kind", "name").agg(F.sum("n").alias("n"), *by.values())


def _ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...], url: str, *keep: Column) -> DataFrame:
    split = pages.select(*keep, host(url).alias("host"), path(url).alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return split.select("*", rule.alias("rule"), verdict.alias("ruled"))


def fit(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    url: str = "url",
    html: str = "html",
    head_words: int = HEAD_WORDS,
    own: float = OWN,
) -> Model:
    """Dictionary from all pages, Bayes model from all urls that a rule decides. Without such urls, all is allowed."""
    counted = materialize(page_words(pages, html))
    total = counted.agg(F.sum("n")).first()[0] or 1
    words = counted.select("word", F.log(F.col("n") / F.lit(total)).alias("log_p"))
    top = counted.orderBy(F.desc("n"), "word").limit(head_words).select("word", "n").toArrow().to_pandas()
    head = {w: math.log(n / total) for w, n in zip(top["word"], top["n"], strict=True)}

    taught = _ruled(pages, rules, url).filter("ruled is not null")
    names = materialize(count_names(taught))
    split = split_names(names.select("name").distinct(), Model(words, head, words, 0.0), own)
    tokens = names.join(split, "name").select("kind", F.explode("words").alias("word"), "allow", "block")
    tokens = tokens.select(_token(F.col("kind"), F.col("word")), "allow", "block")
    learned = materialize(tokens.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    allowed, blocked, kinds = learned.agg(
        F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0)), F.count("*")
    ).first()
    odds = F.log((F.col("block") + 1) / F.lit(float(blocked + kinds))) - F.log(
        (F.col("allow") + 1) / F.lit(float(allowed + kinds))
    )
    urls = dict(taught.groupBy("ruled").count().collect())
    prior = math.log(urls.get("block", 0) + 1) - math.log(urls.get("allow", 0) + 1) if urls else -1.0
    return Model(words, head, learned.select("token", odds.alias("odds")), prior)


def _token(kind: Column, word: Column) -> Column:
    return F.concat(kind, F.lit(":"), word).alias("token")


def score_names(names: DataFrame, model: Model, own: float = OWN) -> DataFrame:
    """(kind, name, n, odds, tokens): every counted name split, its tokens' log odds summed. Unknown tokens count nothing."""
    split = split_names(names.select("name").distinct(), model, own)
    each = names.join(split, "name").select("kind", "name", "n", F.posexplode("words").alias("at", "word"))
    each = each.withColumn("token", _token(F.col("kind"), F.col("word"))).join(model.tokens, "token", "left")
    in_order = F.array_sort(F.collect_list(F.struct("at", "token")))["token"]
    return materialize(
        each.groupBy("kind", "name", "n").agg(
            F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds"), F.array_join(in_order, " ").alias("tokens")
        )
    )


def judge(
    pages: DataFrame,
    model: Model,
    rules: tuple[tuple[str, str], ...] = RULES,
    page_id: str = "page_id",
    url: str = "url",
    head_names: int = HEAD_NAMES,
    own: float = OWN,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, log_odds, words."""
    row = F.monotonically_increasing_id().alias("row")
    urls = materialize(_ruled(pages, rules, url, row, F.col(page_id).alias("page_id")))
    scored = score_names(materialize(count_names(urls)), model, own)
    top = scored.orderBy(F.desc("n"), "kind", "name").limit(head_names).toArrow().to_pandas()
    head = {(k, n): (o, t) for k, n, o, t in zip(top["kind"], top["name"], top["odds"], top["tokens"], strict=True)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, h, p in zip(batch["row"], batch["host"], batch["path"], strict=True):
                odds, known, rare = 0.0, [], []
                for at, named in enumerate(_names(h, p)):
                    if named in head:
                        odds += head[named][0]
                        known.append({"at": at, "tokens": head[named][1]})
                    else:
                        rare.append({"at": at, "kind": named[0], "name": named[1]})
                out.append((key, odds, known, rare))
            yield pd.DataFrame(out, columns=["row", "odds", "known", "rare"])

    told = "row long, odds double, known array<struct<at:int,tokens:string>>, rare array<struct<at:int,kind:string,name:string>>"
    told = materialize(urls.select("row", "host", "path").mapInPandas(run, told))
    looked = (
        told.select("row", F.inline("rare"))
        .join(scored.select("kind", "name", F.col("odds").alias("o"), "tokens"), ["kind", "name"])
        .groupBy("row")
        .agg(F.sum("o").alias("more"), F.collect_list(F.struct("at", "tokens")).alias("found"))
    )
    none = F.array().cast("array<struct<at:int,tokens:string>>")
    in_order = F.array_sort(F.concat("known", F.coalesce("found", none)))["tokens"]
    log_odds = F.round(F.lit(model.prior) + F.col("odds") + F.coalesce("more", F.lit(0.0)), DIGITS)
    learned = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return (
        urls.join(told.join(looked, "row", "left"), "row")
        .withColumn("log_odds", log_odds)
        .select(
            "page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "log_odds",
            F.array_join(in_order, " ").alias("words"),
        )
    )
