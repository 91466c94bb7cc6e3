"""LM scoring with Brown classes: class transitions times word emissions.

Counts are taken over all words of all training texts. Every word of them gets its class by
exchange: it moves to the class that raises the likelihood of the class bigrams most. The most
frequent words do so one after another, until few move. All other words start in a class by
their ending; each is then tried in every class, in the tasks that own the word, against
the class bigrams of the start. Only words that no training text has keep the class of their
ending. Transitions are counted once more when all words have their class. A text's
probability is the product over its tokens of P(class | class before) and P(word | class),
both smoothed by adding to the counts.

What travels is bounded: VOCABULARY words, their bigrams, the transitions of the classes, and
the HEAD_WORDS most frequent words of HEAD_BYTES at most with their classes. All other words
of a text get count and class by a join on the word; the text's path of classes waits for
them in a written table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import held_out, learnable
from gaugeworks.session import materialize

DIVISOR = 5
VOCABULARY = 1500
CLASSES = 40
RARE_CLASSES = 16
SWEEPS = 6
HEAD_WORDS = 150_000
HEAD_BYTES = 32
# Distinct words a task counts before it sends them; texts whose bigrams are counted together.
COUNT_WORDS = 500_000
COUNT_TEXTS = 2_000
# Words that are tried in all classes together.
PLACE_WORDS = 2_000
# Stands in a path for a word whose class comes by the join.
TAIL = 65_535
CONTEXT = pa.schema([("word", pa.binary()), ("slot", pa.int32()), ("n", pa.int64())])
PLACED = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])
TOLD = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64())]
    + [("path", pa.binary()), ("tails", pa.binary()), ("word", pa.binary()), ("place", pa.int32()), ("times", pa.int64())]
)
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLE = bytes.maketrans(*_LOWER)


@dataclass(frozen=True)
class Vocabulary:
    """counts and classes of the exchanged words; transitions between ``size`` classes, the last of them the boundary."""

    counts: dict[bytes, int]
    classes: dict[bytes, int]
    steps: np.ndarray
    train_tokens: int
    texts: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.steps)

    @property
    def first_rare(self) -> int:
        return self.size - 1 - RARE_CLASSES


@dataclass(frozen=True)
class Model:
    """log_step: (classes, classes), of transitions. log_room: emission denominators of the classes."""

    log_step: np.ndarray
    log_room: np.ndarray


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end token is not among them."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def rare_class(word: bytes, first: int) -> int:
    return first + zlib.crc32(word[-2:]) % RARE_CLASSES


def _counted(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(counts), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``docs``; each task sums before it sends. The end token is not counted here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens(text))
                if len(counts) > COUNT_WORDS:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_bigrams(docs: DataFrame, numbers: dict[bytes, int], first_rare: int, boundary: int) -> DataFrame:
    """(a, b, n) of neighbouring numbers: vocabulary words, rare classes, and the boundary at both ends."""
    size = boundary + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: list[np.ndarray] = []
            for at in range(0, len(batch), COUNT_TEXTS):
                row: list[int] = [boundary]
                for text in batch["text"].iloc[at : at + COUNT_TEXTS]:
                    words = tokens(text)
                    row += [numbers[w] if w in numbers else rare_class(w, first_rare) for w in words]
                    row.append(boundary)
                ids = np.array(row, dtype=np.int64)
                total.append(ids[:-1] * size + ids[1:])
            code, n = np.unique(np.concatenate(total) if total else np.zeros(0, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"a": code // size, "b": code % size, "n": n})

    pairs = docs.select("text").mapInPandas(run, "a long, b long, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each row of the bigram counts. Rows from ``words`` on keep a class of their own.

    The likelihood of class bigrams is sum n(c,d) log n(c,d) - 2 sum n(c) log n(c); a move
    changes two rows and two columns of it, which are evaluated for all target classes at once.
    """
    total = counts.sum(axis=1)
    fixed = len(counts) - words
    label = np.r_[np.arange(words) % classes, classes + np.arange(fixed)]
    k = classes + fixed
    member = np.zeros((len(counts), k))
    member[np.arange(len(counts)), label] = 1
    out_of, into = counts @ member, counts.T @ member
    grid = member.T @ out_of
    size_of = member.T @ total
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            old = label[w]
            row, column, own = out_of[w].copy(), into[w].copy(), counts[w, w]
            row[old] -= own
            column[old] -= own
            # take w out of its class
            grid[old] -= row
            grid[:, old] -= column
            grid[old, old] -= own
            size_of[old] -= total[w]
            base_rows, base_columns = grid[:classes], grid[:, :classes].T
            gain = (_plogp(base_rows + row) - _plogp(base_rows)).sum(axis=1)
            gain += (_plogp(base_columns + column) - _plogp(base_columns)).sum(axis=1)
            at = np.arange(classes)
            corner = grid[at, at]
            gain -= _plogp(corner + row[:classes]) + _plogp(corner + column[:classes]) - 2 * _plogp(corner)
            gain += _plogp(corner + row[:classes] + column[:classes] + own) - _plogp(corner)
            gain -= 2 * (_plogp(size_of[:classes] + total[w]) - _plogp(size_of[:classes]))
            new = int(np.argmax(gain + 1e-9 * (at == old)))
            grid[new] += row
            grid[:, new] += column
            grid[new, new] += own
            size_of[new] += total[w]
            if new != old:
                moved += 1
                label[w] = new
                out_of[:, old] -= counts[:, w]
                out_of[:, new] += counts[:, w]
                into[:, old] -= counts[w]
                into[:, new] += counts[w]
        if moved <= words // 200:
            break
    return label


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES) -> Vocabulary:
    """Exchanged classes of the most frequent words of texts in column ``text``; all words are counted."""
    counts = materialize(word_counts(docs))
    texts, total, distinct = docs.count(), *counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    chosen = {bytes(r.word): r.n for r in most_frequent(counts).limit(vocabulary).collect()}
    numbers = {w: i for i, w in enumerate(chosen)}
    first_rare, boundary = len(chosen), len(chosen) + RARE_CLASSES
    table = class_bigrams(docs, numbers, first_rare, boundary).toArrow().to_pandas()
    grid = np.zeros((boundary + 1, boundary + 1))
    grid[table["a"], table["b"]] = table["n"]
    classes = max(1, min(classes, len(chosen)))
    label = exchange(grid, len(chosen), classes)
    member = np.zeros((len(grid), classes + RARE_CLASSES + 1))
    member[np.arange(len(grid)), label] = 1
    found = dict(zip(chosen, label.tolist(), strict=False))
    return Vocabulary(chosen, found, member.T @ grid @ member, int(total) + texts, texts, distinct + (texts > 0))


def most_frequent(counts: DataFrame) -> DataFrame:
    """Words of HEAD_BYTES at most, the most frequent first."""
    return counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word")


def contexts(docs: DataFrame, model: Vocabulary) -> DataFrame:
    """(word, slot, n) of all words outside the vocabulary: how often a class is next to them.

    With k classes, slot c is class c after the word, k + c class c before it, and 2k the word
    itself after it, which the other slots leave out.
    """
    k, start = model.size, model.size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), COUNT_TEXTS):
                number: dict[bytes, int] = {}
                row: list[int] = [-1 - start]
                for text in texts[at : at + COUNT_TEXTS]:
                    for w in tokens(text):
                        c = model.classes.get(w)
                        row.append(number.setdefault(w, len(number)) if c is None else -1 - c)
                    row.append(-1 - start)
                told = np.array(row, dtype=np.int64)
                ending = np.array([rare_class(w, model.first_rare) for w in number], dtype=np.int64)
                path = -1 - told
                mine = np.flatnonzero(told >= 0)
                path[mine] = ending[told[mine]]
                word, after, before = told[mine], told[mine + 1], told[mine - 1]
                slot = np.where(after == word, 2 * k, path[mine + 1])
                other = before != word
                code = np.r_[word * (2 * k + 1) + slot, (word * (2 * k + 1) + k + path[mine - 1])[other]]
                code, n = np.unique(code, return_counts=True)
                words = pa.array(list(number), pa.binary()).take(pa.array(code // (2 * k + 1)))
                yield pa.RecordBatch.from_arrays([words, pa.array((code % (2 * k + 1)).astype(np.int32)), pa.array(n)], schema=CONTEXT)

    return docs.select("text").mapInArrow(run, "word binary, slot int, n long")


def best_classes(steps: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each word, if it alone leaves its class ``old``; see ``exchange``.

    ``after`` and ``before`` count the classes next to a word, the word itself left out, which
    ``own`` counts. The last class is the boundary, which no word joins.
    """
    classes = len(steps) - 1
    at = np.arange(classes)
    word = np.arange(len(old))
    gain = np.zeros((len(old), classes))
    for table, seen, other in ((steps.T, after, before), (steps, before, after)):
        w, near = np.nonzero(seen)
        if not len(w):
            continue
        n = seen[w, near]
        base = table[near, :classes]
        # take the word out of its class
        base[np.arange(len(w)), old[w]] -= n
        same = np.flatnonzero(near == old[w])
        base[same] -= other[w[same], :classes]
        base[same, old[w[same]]] -= own[w[same]]
        change = _plogp(base + n[:, None]) - _plogp(base)
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(change, first)
    row, column = after[:, :classes], before[:, :classes]
    corner = np.tile(steps[at, at], (len(old), 1))
    corner[word, old] -= row[word, old] + column[word, old] + own
    gain -= _plogp(corner + row) + _plogp(corner + column) - 2 * _plogp(corner)
    gain += _plogp(corner + row + column + own[:, None]) - _plogp(corner)
    total = after.sum(axis=1) + own
    size = np.tile(steps.sum(axis=1)[:classes], (len(old), 1))
    size[word, old] -= total
    gain -= 2 * (_plogp(size + total[:, None]) - _plogp(size))
    return np.argmax(gain + 1e-9 * (at == old[:, None]), axis=1)


def placed(docs: DataFrame, model: Vocabulary) -> DataFrame:
    """(word, n, class) of all words of the texts that are not in the vocabulary."""
    k = model.size

    def place(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words = rows.column("word").combine_chunks()
        new = np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]
        word, names = np.cumsum(new) - 1, words.filter(pa.array(new))
        slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
        for low in range(0, len(names), PLACE_WORDS):
            high = min(low + PLACE_WORDS, len(names))
            a, b = np.searchsorted(word, [low, high])
            code = (word[a:b] - low) * (2 * k + 1) + slot[a:b]
            seen = np.bincount(code, n[a:b], (high - low) * (2 * k + 1)).reshape(high - low, 2 * k + 1)
            part, own = names[low:high], seen[:, 2 * k]
            old = np.array([rare_class(w, model.first_rare) for w in part.to_pylist()], dtype=np.int64)
            best = best_classes(model.steps, seen[:, :k], seen[:, k : 2 * k], own, old)
            total = (seen[:, :k].sum(axis=1) + own).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part, pa.array(total), pa.array(best.astype(np.int32))], schema=PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by word: the last word of a batch may go on in the next
        held = CONTEXT.empty_table()
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(CONTEXT)])
            words = held.column("word")
            if not held.num_rows or words[0] == words[-1]:
                continue
            last = pc.index(words, words[-1]).as_py()
            yield from place(held[:last])
            held = held[last:]
        if held.num_rows:
            yield from place(held)

    near = contexts(docs, model).repartition("word").sortWithinPartitions("word")
    return near.mapInArrow(run, "word binary, n long, class int")


def told_paths(docs: DataFrame, head: dict[bytes, tuple[float, int]], start: int, ends: int) -> DataFrame:
    """One row per text, with its path of classes, and one per text and word that is not in ``head``; see TOLD.

    ``tails`` has, in the order of the path, the numbers of the words that are not in ``head``.
    """
    end_log = float(np.log10(ends + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[tuple] = []
            names, source, places, times = [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                logs, path, tails, number = end_log, [start], [], {}
                for w in tokens(text):
                    got = head.get(w)
                    if got is None:
                        path.append(TAIL)
                        tails.append(number.setdefault(w, len(number)))
                    else:
                        logs += got[0]
                        path.append(got[1])
                path.append(start)
                n = len(path) - 1
                rare = np.array(tails, dtype=np.uint32)
                texts.append((n, n - 1 - len(tails) + (ends > 0), logs, np.array(path, dtype=np.uint16).tobytes(), rare.tobytes()))
                names += number
                source += [row] * len(number)
                places += range(len(number))
                times.append(np.bincount(rare, minlength=len(number)))
            columns = zip(*texts, strict=True) if texts else [[]] * 5
            whole = dict(zip(TOLD.names[2:7], columns, strict=True))
            yield _told(len(texts), row=batch.column("row"), doc_id=batch.column("doc_id"), **whole)
            count = np.concatenate(times) if times else []
            yield _told(len(names), row=source, word=names, place=places, times=count)

    # The row number only ties a text's rare words to it; it is written down with them.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_tokens long, n_known long, logs double, path binary, tails binary"
    return numbered.mapInArrow(run, f"{schema}, word binary, place int, times long")


def _told(rows: int, **columns) -> pa.RecordBatch:
    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in TOLD]
    return pa.RecordBatch.from_arrays(made, schema=TOLD)


def with_tails(told: DataFrame, rest: DataFrame, first_rare: int) -> DataFrame:
    """The texts of ``told`` with the classes, counts and emissions of their words that did not travel."""
    body = told.filter("word is null").drop("word", "place", "times")
    tail = told.filter("word is not null").select("row", "word", "place", "times").join(rest, "word", "left")
    ending = F.expr("substring(word, greatest(1, octet_length(word) - 1))")
    own = F.coalesce("class", (F.crc32(ending) % RARE_CLASSES + first_rare).cast("int")).alias("class")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    seen = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    summed = tail.groupBy("row").agg(
        F.sum(log).alias("tail_log"),
        F.sum(seen).alias("tail_known"),
        F.sort_array(F.collect_list(F.struct("place", own)))["class"].alias("classes"),
    )
    return body.join(summed, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("tail_log", F.lit(0.0))).alias("logs"),
        "path",
        "tails",
        "classes",
    )


def _path(path: bytes, tails: bytes, classes: np.ndarray | None) -> np.ndarray:
    out = np.frombuffer(path, dtype=np.uint16).astype(np.int64)
    if len(tails):
        out[out == TAIL] = np.asarray(classes)[np.frombuffer(tails, dtype=np.uint32)]
    return out


def transitions(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of neighbouring classes over the paths of ``texts``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for parts in zip(batch["path"], batch["tails"], batch["classes"], strict=True):
                p = _path(*parts)
                total += np.bincount(p[:-1] * size + p[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"a": at // size, "b": at % size, "n": total[at]})

    pairs = texts.select("path", "tails", "classes").mapInPandas(run, "a long, b long, n long")
    table = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    steps = np.zeros((size, size))
    steps[table["a"], table["b"]] = table["n"]
    return steps


def smoothed(steps: np.ndarray, types: np.ndarray) -> Model:
    """``types``: how many different words a class has."""
    step = np.log10(steps + 0.5) - np.log10(steps.sum(axis=1, keepdims=True) + 0.5 * len(steps))
    # Emission: (n(word) + 0.5) / (n(class) + 0.5 (word types of the class + 1)).
    return Model(step, np.log10(steps.sum(axis=0) + 0.5 * (types + 1)))


def score(texts: DataFrame, model: Model, train_tokens: int, distinct: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of ``texts`` as ``with_tails`` gives them."""
    base_room = float(np.log10(train_tokens + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [_path(*parts) for parts in zip(batch["path"], batch["tails"], batch["classes"], strict=True)]
            own = [float(model.log_step[p[:-1], p[1:]].sum() - model.log_room[p[1:]].sum()) for p in paths]
            out = batch[["doc_id", "n_tokens", "n_known"]].assign(base_score=batch["logs"] - batch["n_tokens"] * base_room)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), score=batch["logs"] + np.array(own, dtype=np.float64))

    return texts.mapInPandas(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR, vocabulary: int = VOCABULARY,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    NULL texts are empty: their one token is the end. Without training texts every count is 0.
    Rows without an id are scored but not learned from. ``head_words`` travel with the tasks,
    the vocabulary among them; scores do not depend on how many.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    taught = plain.filter(learnable("doc_id", divisor))
    found = fit(taught, vocabulary)
    rest = materialize(placed(taught, found))
    head = {w: (float(np.log10(n + 0.5)), found.classes[w]) for w, n in found.counts.items()}
    near = most_frequent(rest).limit(max(0, head_words - len(head))).toArrow()
    for w, n, c in zip(*(near.column(name).to_pylist() for name in ("word", "n", "class")), strict=True):
        head[w] = float(np.log10(n + 0.5)), c
    told = materialize(told_paths(plain, head, found.size - 1, found.texts))
    texts = materialize(with_tails(told, rest, found.first_rare))
    types = np.zeros(found.size)
    np.add.at(types, list(found.classes.values()), 1)
    for number, n in rest.groupBy("class").count().collect():
        types[number] += n
    model = smoothed(transitions(texts.filter(learnable("doc_id", divisor)), found.size), types)
    return score(texts, model, found.train_tokens, found.distinct).select(
        "doc_id",
        held_out("doc_id", divisor).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(found.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
