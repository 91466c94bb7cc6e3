"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A text is a weighted set: its five-word shingles with their counts. Each shingle is a
Poisson process whose rate is its weight; every arrival lands in one of m registers, and a
register keeps the shingle that arrived first. Two texts keep the same shingle with the
probability J_P, the probability Jaccard similarity, which is the plain Jaccard similarity
where all weights are equal. A shingle stops as soon as its next arrival comes after the
latest register, which ends nearly all of them after one.

Registers are cut into bands. Texts that agree in a band are candidates, and candidates are
verified by the exact Jaccard similarity of their shingles, to which the threshold refers. As
J_P is far below it where one text repeats a line, a text with repeated shingles has the bands
of its shingles with all weights 1 too; in any other text both are the same keys. Texts with equal words are one text from the start, so copies cost
nothing. In a bucket every text is first verified against the smallest id, the leader: a
group of any size is linked by as many pairs as it has members. Where a leader's texts are
still in several classes, the one nearest to it outside its own class leads them once more,
and again (ROUNDS), which joins families whose first leader lay at their edge.

Texts of a bucket that are still in different classes may be linked past their leader. Let
R be what a text lacks of the leader's shingles, A what it has beside them. If b is not
linked to the leader L, and a and b have no added shingle in common, then a and b share
|L| - |R_a| - |R_b| + |R_a & R_b| shingles, and for a link they must lack more than
|R_a| - t (|R_a| - |A_a|) in common, with t = s / (1 + s) for the similarity s. So only pairs with a
common added shingle, or with nearly all of R_a lacking in b too, can be linked: they are
found by joining on shingles, and verified. So no link between texts of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import batches_of
from gaugeworks.llm.components import components
from gaugeworks.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
# A pair at the threshold agrees in some band of weights 1 with probability 1 - (1 - 0.8**6)**24 = 0.9993.
BANDS = 24
BAND_ROWS = 6
# Words sketched at once in a task; one longer text is sketched alone.
CHUNK_WORDS = 100_000
# Texts, or pairs with their shingles, that come to a task at once.
BATCH_ROWS = 1_000
EPSILON = 1e-9
# Slots in which shingles are counted to put rare ones first: a table of this size goes with the tasks, whatever the input.
ORDER_SLOTS = 2**18
# Elections of further leaders before the remaining pairs are looked for one by one.
ROUNDS = 3

SKETCH = "doc_id long, same string, bands array<long>, shingles binary"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: list[list[bytes]], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted by both. A text of fewer words is one shingle of all of them."""
    import xxhash

    word_hash = xxhash.xxh3_64_intdigest
    lengths = np.array([len(t) for t in texts])
    words = np.fromiter((word_hash(w) for t in texts for w in t), dtype=np.uint64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    span = np.minimum(lengths, width)[owner]
    starts = np.flatnonzero(place + span <= lengths[owner])
    code = np.zeros(len(starts), dtype=np.uint64)
    for k in range(width):
        at = np.minimum(starts + k, len(words) - 1)
        code = np.where(k < span[starts], code * _ODD + mix(words[at]), code)
    code, document = mix(code), owner[starts]
    order = np.lexsort((code, document))
    code, document = code[order], document[order]
    if not len(code):
        return document, code, np.zeros(0, dtype=np.int64)
    first = np.r_[True, (code[1:] != code[:-1]) | (document[1:] != document[:-1])]
    at = np.flatnonzero(first)
    return document[at], code[at], np.diff(np.r_[at, len(code)])


def registers(document: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) shingles that arrived first in each register of each document."""
    best = np.full(n * m, np.inf)
    owner = np.zeros(n * m, dtype=np.uint64)
    time = np.zeros(len(shingle))
    document, weight = document.astype(np.int64), weight.astype(np.float64)
    turn = 0
    while len(shingle):
        turn += 1
        with np.errstate(over="ignore"):
            bits = mix(shingle + np.uint64(turn) * _GOLDEN)
        # 40 bits make the waiting time, the other 24 the register.
        time = time - np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight
        register = document * m + ((bits & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        early = np.flatnonzero(time < best[register])
        if len(early):
            np.minimum.at(best, register[early], time[early])
            won = early[best[register[early]] == time[early]]
            owner[register[won]] = shingle[won]
        present = np.flatnonzero(np.bincount(document, minlength=n))
        latest = np.full(n, -np.inf)
        latest[present] = best.reshape(n, m)[present].max(axis=1)
        alive = time < latest[document]
        document, shingle, weight, time = document[alive], shingle[alive], weight[alive], time[alive]
    return owner.reshape(n, m)


def band_keys(owners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys of the registers' bands."""
    owners = owners.reshape(len(owners), bands, rows)
    with np.errstate(over="ignore"):
        keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLDEN
        for k in range(rows):
            keys = mix(keys * _ODD + owners[:, :, k])
    return keys.view(np.int64)


def _sketch_chunk(ids: list, texts: list[list[bytes]], bands: int, rows: int) -> pd.DataFrame:
    import xxhash

    document, shingle, count = weighted_shingles(texts)
    keys = list(band_keys(registers(document, shingle, count, len(texts), bands * rows), bands, rows))
    heavy = np.unique(document[count > 1])
    if len(heavy):
        part = np.isin(document, heavy)
        owner, one = np.searchsorted(heavy, document[part]), np.ones(int(part.sum()))
        plain = band_keys(registers(owner, shingle[part], one, len(heavy), bands * rows), bands, rows)
        for i, row in zip(heavy.tolist(), plain, strict=True):
            keys[i] = np.union1d(keys[i], row)
    bounds = np.searchsorted(document, np.arange(len(texts) + 1))
    short = (shingle >> np.uint64(32)).astype("<u4")
    out = []
    for i, (key, words) in enumerate(zip(ids, texts, strict=True)):
        part = slice(bounds[i], bounds[i + 1])
        same = xxhash.xxh3_128_hexdigest(b" ".join(words))
        out.append((key, same, keys[i] if words else None, short[part].tobytes()))
    return pd.DataFrame(out, columns=["doc_id", "same", "bands", "shingles"])


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row with an id: doc_id, same (hash of all words), bands (NULL without words), shingles.

    Shingles are 32-bit hashes in rising order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                words = (value or "").encode("utf-8", "replace").split()
                if texts and size + len(words) > CHUNK_WORDS:
                    yield _sketch_chunk(ids, texts, bands, rows)
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(words)
                size += len(words)
            if ids:
                yield _sketch_chunk(ids, texts, bands, rows)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    return plain.mapInPandas(run, SKETCH)


def jaccard(a: bytes, b: bytes) -> float:
    """Exact Jaccard similarity of two sketches' shingles; 0 where one has none."""
    x, y = np.unique(np.frombuffer(a, dtype="<u4")), np.unique(np.frombuffer(b, dtype="<u4"))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _lacking(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shingles of ``a`` that ``b`` has not, in rising order."""
    sets = ((np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")) for x, y in zip(a, b, strict=True))
    return pd.Series([np.setdiff1d(x, y).astype(np.int64) for x, y in sets], dtype=object)


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    left = sketches.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").withColumn("similarity", _similarity("sa", "sb"))


def verify(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, similarity) of every pair."""
    return _with_sketches(pairs, sketches).select("a", "b", "similarity")


def _crowding(members: DataFrame) -> np.ndarray:
    """How many added shingles of all members fall into each of ORDER_SLOTS slots of their hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(ORDER_SLOTS, dtype=np.int64)
        for batch in batches:
            for added in batch["added"]:
                np.add.at(counts, np.asarray(added, dtype=np.int64) % ORDER_SLOTS, 1)
        slots = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": slots, "n": counts[slots]})

    rows = members.select("added").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    crowding = np.zeros(ORDER_SLOTS, dtype=np.int64)
    for slot, n in rows:
        crowding[slot] = n
    return np.minimum(crowding, 2**30)


def _rarest(crowding: np.ndarray, added: str, length: Column) -> Column:
    """The first ``length`` added shingles by (crowding of the slot, hash), as one number each.

    Any order that is the same for all texts would do for the prefix filter; this one keeps the shingles
    of a common passage out of prefixes, where they would pair all texts that hold it.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def first(shingles: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for row, n in zip(shingles, lengths, strict=True):
            hashes = np.asarray(row, dtype=np.int64)
            out.append(np.sort((crowding[hashes % ORDER_SLOTS] << 32) | hashes)[:n])
        return pd.Series(out, dtype=object)

    return first(added, length)


def _open_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one leader and different labels that may be linked.

    ``members``: lead, doc_id, label, similarity (to the leader), size, added, removed.
    """
    linked = F.col("similarity") >= similarity - EPSILON
    share = similarity / (1 + similarity)
    told = members.select(
        "*",
        linked.alias("linked"),
        F.lit(0).alias("left"),
        F.lit(0).cast("long").alias("last"),
        F.lit(0).cast("long").alias("shared"),
        F.size("added").alias("plus"),
        F.size("removed").alias("minus"),
        # removed shingles of a that b must meet in one, if it lacks as many of them as it must
        F.greatest(F.lit(0), F.ceil((F.size("removed") - F.size("added")) * share)).cast("int").alias("some"),
    )
    facts = ("label", "linked", "size", "plus", "minus", "left", "last", "shared")

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{name}") for c in facts]
        return df.select("lead", *more, F.col("doc_id").alias(name), *named)

    apart = (F.col("a") != F.col("b")) & (F.col("label_a") != F.col("label_b"))
    # What a and b must lack or have added in common, for a link.
    leader = F.col("size_a") - F.col("plus_a") + F.col("minus_a")
    need = share * (F.col("size_a") + F.col("size_b")) - leader + F.col("minus_a") + F.col("minus_b") - EPSILON
    lacked = F.least("minus_a", "minus_b")
    far = told.filter(~linked)

    # Prefix filter: with added shingles first, rare ones foremost, a link has a common shingle among the
    # first (1 - s) |a| + 1 of both. Only these leave the row. Shingles whose holders are all in one class
    # pair nothing. Past the end of the prefix that ends first, a pair has no more in common than is left there.
    length = (F.floor(F.col("size") * (1 - similarity) + EPSILON) + 1).cast("int")
    head = told.withColumn("head", _rarest(_crowding(told), "added", length)).drop("added", "removed")
    head = head.withColumns({"last": F.element_at("head", -1), "left": F.col("plus") - F.size("head")})
    held = materialize(head.repartition("doc_id").select("*", F.explode("head").alias("shingle")).drop("head"))
    several = held.groupBy("lead", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = several.filter("low < high").select("lead", "shingle")
    one = Window.partitionBy("lead", "doc_id")
    prefixes = held.join(several, ["lead", "shingle"], "left_semi").withColumn("shared", F.count("*").over(one))
    prefixes = materialize(prefixes)
    later = F.when(F.col("last_a") <= F.col("last_b"), F.col("left_a")).otherwise(F.col("left_b"))
    common = (
        side(prefixes, "a", "shingle")
        .join(side(prefixes.filter(~linked), "b", "shingle"), ["lead", "shingle"])
        .filter(apart & (need <= lacked + later + F.least("shared_a", "shared_b")))
        .groupBy("lead", "a", "b")
        .agg(F.count("*").alias("met"), F.first(need - lacked - later).alias("wanted"))
        .filter("wanted <= met")
        .select("a", "b")
    )
    # Without a common added shingle, all that b shares with a it shares with the leader.
    inner = F.col("plus") <= F.col("size") * (1 - similarity) + EPSILON
    shrunk = told.filter((F.col("some") > 0) & inner)
    some = side(shrunk.withColumn("shingle", F.explode(F.slice("removed", F.lit(1), F.col("some")))), "a", "shingle", "removed")
    lost = far.filter(inner).join(shrunk.select("lead").distinct(), "lead", "left_semi").repartition("doc_id")
    lost = lost.withColumn("shingle", F.explode("removed"))
    lost = side(lost, "b", "shingle", "removed").withColumnRenamed("removed", "removed_b")
    enough = F.size(F.array_intersect("removed", "removed_b")) >= need
    lacking = some.join(lost, ["lead", "shingle"]).filter(apart & (need <= lacked) & enough).select("a", "b")

    every = common.unionByName(lacking)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row with an id: doc_id, class_id (the smallest id of its class), class_size, kept.

    Texts without words, NULL or empty, stand alone. Rows without an id are not compared and
    not returned. Rows that repeat an id are in one class with all their texts.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _near_classes(docs, doc_id, text, similarity)


def _near_classes(docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    sketches = materialize(sketch(docs, doc_id, text))
    distinct = materialize(
        sketches.filter("bands is not null").groupBy("same", "bands").agg(F.min("doc_id").alias("doc_id"))
    )
    entries = distinct.select("doc_id", F.explode("bands").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
    led = entries.join(leaders.filter("lead < last").drop("last"), "key")
    pairs = led.filter("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = materialize(pairs)
    # Only texts that share a bucket move with their shingles, and only once.
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    names = distinct.select("doc_id", "same").join(involved, "doc_id", "left_semi")
    representatives = materialize(sketches.drop("bands").join(names, ["doc_id", "same"], "left_semi"))
    told = _with_sketches(pairs, representatives).select(
        "a",
        "b",
        "similarity",
        F.floor(F.length("sb") / 4).alias("size"),
        _lacking("sb", "sa").alias("added"),
        _lacking("sa", "sb").alias("removed"),
    )
    first = materialize(told)
    enough = F.col("similarity") >= similarity - EPSILON
    label = components(first.filter(enough).select("a", "b"))

    for _ in range(ROUNDS):
        members = _split_groups(first.drop("size", "added", "removed"), label)
        if members.isEmpty():
            break
        outside = members.filter("label <> lead_label")
        chosen = outside.groupBy("lead").agg(F.max(F.struct("similarity", "doc_id", "label")).alias("next"))
        further = (
            members.join(chosen, "lead")
            .filter("doc_id <> next.doc_id and label <> next.label")
            .select(F.least("next.doc_id", "doc_id").alias("a"), F.greatest("next.doc_id", "doc_id").alias("b"))
            .distinct()
        )
        label = _merged(label, verify(further, representatives).filter(enough))

    rest = _open_pairs(_split_groups(first, label), similarity).join(first.select("a", "b"), ["a", "b"], "left_anti")
    label = _merged(label, verify(rest, representatives).filter(enough))

    through = (
        distinct.select(F.col("doc_id").alias("node"), "same")
        .join(label, "node", "left")
        .select("same", F.coalesce("label", "node").alias("class_id"))
    )
    placed = sketches.select("doc_id", "same").join(through, "same", "left")
    placed = placed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    placed = _one_class_per_id(placed)
    sizes = placed.groupBy("class_id").agg(F.count("*").alias("class_size"))
    kept = (F.col("doc_id") == F.col("class_id")).alias("kept")
    return placed.join(sizes, "class_id").select("doc_id", "class_id", "class_size", kept)


def _split_groups(first: DataFrame, label: DataFrame) -> DataFrame:
    """The verified pairs (lead, doc_id, ...) of leaders whose texts are in several classes, with both labels."""
    named = first.withColumnRenamed("a", "lead").withColumnRenamed("b", "doc_id")
    own = named.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = own.withColumn("label", F.coalesce("label", "doc_id"))
    lead = label.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    own = own.join(lead, "lead", "left").withColumn("lead_label", F.coalesce("lead_label", "lead"))
    split = own.groupBy("lead").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return materialize(own.join(split.filter("n > 1 and low < high").select("lead"), "lead", "left_semi"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links (a, b) between nodes of any class or none."""
    end = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
    contracted = (
        links.join(end("a"), "a", "left")
        .join(end("b"), "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    top = materialize(components(materialize(contracted)))
    moved = label.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    fresh = top.join(label.select("node"), "node", "left_anti")
    return materialize(moved.select("node", F.coalesce("top", "label").alias("label")).unionByName(fresh))


def _one_class_per_id(placed: DataFrame) -> DataFrame:
    """Merges the classes of an id that came with several texts; without such ids, as it was."""
    placed = materialize(placed)
    several = placed.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b")
    if several.isEmpty():
        return placed
    merged = components(placed.join(several.select("doc_id"), "doc_id", "left_semi").join(several.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")))
    return placed.join(merged.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", F.coalesce("label", "class_id").alias("class_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: of each class those with the smallest id. Rows without an id stay."""
    dropped = near_classes(docs, doc_id, text, similarity).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[doc_id] == dropped["_dropped"], "left_anti")
