"""Language identification with a bidirectional gated recurrent network over bytes.

A text is cut into windows of SPAN bytes, which run side by side. Two gated recurrent layers
read each window forwards and backwards; at every byte their states together give a
distribution over the languages. A text's distribution is the mean over all its bytes, so
every byte of a whole text counts.

The network is trained in numpy by backpropagation through time, with the true language as
the label of every position, on a bounded sample: TRAIN_TEXTS texts a language at most, those
with the smallest hashed ids, TRAIN_WINDOWS windows of them in all. Gates are piecewise linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import held_out, learnable

DIVISOR = 3
SPAN = 64
HIDDEN = 8
PAD = 256
TRAIN_TEXTS = 300
TRAIN_WINDOWS = 6_000
BATCH = 256
EPOCHS = 8
RATE = 0.01
# Windows that run side by side when texts are read.
LANES = 2_048
UNDECIDED = "und"


@dataclass(frozen=True)
class Network:
    """Of each direction: input (257, 3H) by byte with biases, gates (H, 2H), candidate (H, H). out (2H + 1, languages)."""

    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]


def windows(raw: bytes) -> np.ndarray:
    """(n, SPAN) bytes, the last window padded."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    n = -(-len(data) // SPAN)
    out = np.full(n * SPAN, PAD, dtype=np.int64)
    out[: len(data)] = data
    return out.reshape(n, SPAN)


def run_layer(columns: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], keep: bool = False):
    """States (SPAN, lanes, H) of one direction over (SPAN, lanes) bytes; with what backpropagation needs, if asked."""
    enter, gates, candidate = tables
    h_size = candidate.shape[0]
    lanes = columns.shape[1]
    h = np.zeros((lanes, h_size), dtype=np.float32)
    states, kept = np.empty((len(columns), lanes, h_size), dtype=np.float32), []
    x = np.empty((lanes, 3 * h_size), dtype=np.float32)
    for t, column in enumerate(columns):
        np.take(enter, column, axis=0, out=x, mode="clip")
        gate = h @ gates
        gate += x[:, : 2 * h_size]
        gate *= np.float32(0.2)
        gate += np.float32(0.5)
        np.clip(gate, 0, 1, out=gate)
        z, r = gate[:, :h_size], gate[:, h_size:]
        n = (r * h) @ candidate
        n += x[:, 2 * h_size :]
        np.tanh(n, out=n)
        new = h + z * (n - h)
        if keep:
            kept.append((h, z, r, n))
        h = new
        states[t] = h
    return states, kept


def _layers(weights: dict[str, np.ndarray], side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return weights[f"enter_{side}"], weights[f"gates_{side}"], weights[f"candidate_{side}"]


def position_probabilities(network: Network, batch: np.ndarray) -> np.ndarray:
    """(languages, SPAN, windows) of a (windows, SPAN) batch of bytes."""
    columns = np.ascontiguousarray(batch.T)
    ahead, _ = run_layer(columns, _layers(network.weights, "ahead"))
    back, _ = run_layer(columns[::-1], _layers(network.weights, "back"))
    out = network.weights["out"]
    h = HIDDEN
    flat = out[:h].T @ ahead.reshape(-1, h).T + out[h : 2 * h].T @ back[::-1].reshape(-1, h).T + out[-1][:, None]
    flat -= flat.max(axis=0)
    np.exp(flat, out=flat)
    flat /= flat.sum(axis=0)
    return flat.reshape(len(network.languages), SPAN, len(batch))


def _back_layer(columns, tables, kept, grad):
    """Gradients of one direction from those of its states."""
    enter, gates, candidate = tables
    h_size = candidate.shape[0]
    d_enter, d_gates, d_candidate = np.zeros_like(enter), np.zeros_like(gates), np.zeros_like(candidate)
    carry = np.zeros_like(grad[0])
    for t in range(len(columns) - 1, -1, -1):
        h, z, r, n = kept[t]
        carry = carry + grad[t]
        d_z, d_n = carry * (n - h), carry * z * (1 - n * n)
        d_rh = d_n @ candidate.T
        d_candidate += (r * h).T @ d_n
        gate, d_gate = np.concatenate([z, r], axis=1), np.concatenate([d_z, d_rh * h], axis=1)
        d_gate = np.where((gate > 0) & (gate < 1), d_gate * np.float32(0.2), 0).astype(np.float32)
        d_gates += h.T @ d_gate
        np.add.at(d_enter, columns[t], np.concatenate([d_gate, d_n], axis=1))
        carry = carry * (1 - z) + d_rh * r + d_gate @ gates.T
    return d_enter, d_gates, d_candidate


def train(texts: list[bytes], labels: list[str], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Texts in a fixed order give the same network again."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    pieces = [windows(t) for t in texts]
    rows = np.concatenate(pieces)
    label = np.repeat([languages.index(x) for x in labels], [len(p) for p in pieces])
    # as many windows of each language as the share of the sample allows
    order = rng.permutation(len(rows))
    turn = np.concatenate([np.flatnonzero(label[order] == k)[: TRAIN_WINDOWS // len(languages)] for k in range(len(languages))])
    rows, label = rows[order[turn]], label[order[turn]]
    h, size = HIDDEN, len(languages)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    weights = {f"{n}_{s}": draw(*shape) for s in ("ahead", "back") for n, shape in (("enter", (257, 3 * h)), ("gates", (h, 2 * h)), ("candidate", (h, h)))}
    weights["out"] = draw(2 * h + 1, size)
    first, second = ({n: np.zeros_like(w) for n, w in weights.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            step += 1
            part = order[at : at + BATCH]
            grads = _gradients(Network(languages, weights), rows[part], label[part])
            for name, grad in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad * grad
                size_of = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6
                weights[name] = (weights[name] - RATE * first[name] / (1 - 0.9**step) / size_of).astype(np.float32)
    return Network(languages, weights)


def _gradients(network: Network, batch: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over all positions that are not padding."""
    w, h = network.weights, HIDDEN
    columns = np.ascontiguousarray(batch.T)
    ahead, kept_a = run_layer(columns, _layers(w, "ahead"), keep=True)
    back, kept_b = run_layer(columns[::-1], _layers(w, "back"), keep=True)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    score = both @ w["out"][:-1] + w["out"][-1]
    score -= score.max(axis=2, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(label)), label] -= 1
    real = (columns != PAD)[..., None]
    p = (p * real / max(1, real.sum())).astype(np.float32)
    flat = p.reshape(-1, p.shape[2])
    d_out = np.concatenate([both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0, keepdims=True)])
    d_both = p @ w["out"][:-1].T
    a = _back_layer(columns, _layers(w, "ahead"), kept_a, d_both[..., :h])
    b = _back_layer(columns[::-1], _layers(w, "back"), kept_b, d_both[::-1, :, h:])
    names = ("enter", "gates", "candidate")
    return {"out": d_out, **{f"{n}_ahead": g for n, g in zip(names, a, strict=True)}, **{f"{n}_back": g for n, g in zip(names, b, strict=True)}}


def predict(network: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each whole text; texts without a letter are undecided with score 0."""
    raws = [t.encode("utf-8", "replace") if t and any(map(str.isalpha, t)) else b"" for t in texts]
    counts = np.array([-(-len(r) // SPAN) for r in raws])
    pooled = np.zeros((len(texts), len(network.languages)))
    owner = np.repeat(np.arange(len(texts)), counts)
    # Texts follow one another, so a group of lanes holds some texts or a part of a long one.
    done, texts_at = 0, 0
    waiting: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal done, size
        batch = np.concatenate(waiting)
        for at in range(0, len(batch), LANES):
            part = batch[at : at + LANES]
            p = position_probabilities(network, part) * (part.T != PAD)
            sums = p.sum(axis=1)
            own = owner[done : done + len(part)]
            for k in range(len(network.languages)):
                pooled[:, k] += np.bincount(own, weights=sums[k], minlength=len(texts))
            done += len(part)
        waiting.clear()
        size = 0

    for texts_at in range(len(raws)):
        if counts[texts_at]:
            waiting.append(windows(raws[texts_at]))
            size += counts[texts_at]
            if size >= LANES:
                flush()
    if waiting:
        flush()
    mean = pooled / np.maximum(1, [len(r) for r in raws])[:, None]
    best = mean.argmax(axis=1)
    return [
        (network.languages[k], float(min(1.0, mean[i, k]))) if counts[i] else (UNDECIDED, 0.0) for i, k in enumerate(best)
    ]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", divisor: int = DIVISOR) -> Network | None:
    """Learns from rows that are not held out and have a language and a text; without any, there is no network."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.filter(learnable("doc_id", divisor) & F.col("lang").isNotNull() & (F.length("text") > 0))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TRAIN_TEXTS)
    # TRAIN_TEXTS ids a language: bounded, hence the broadcast.
    picked = known.join(F.broadcast(sample.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    rows = picked.toArrow().to_pandas().sort_values(["lang", "doc_id", "text"])
    if rows.empty:
        return None
    return train([t.encode("utf-8", "replace") for t in rows["text"]], rows["lang"].tolist())


def identify(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Without a network all is undecided."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            told = predict(network, texts.tolist()) if network else [(UNDECIDED, 0.0)] * len(texts)
            yield pd.DataFrame(told, columns=["lang_pred", "score"])

    told = docs.select(F.col(doc_id).alias("doc_id"), said(F.col(text)).alias("said"))
    return told.select("doc_id", held_out("doc_id", divisor).alias("held_out"), "said.lang_pred", "said.score")
