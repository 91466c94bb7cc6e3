"""Quality rules: a learned decision list of threshold conjunctions.

Every text is measured once (counts of words, symbols, repeated lines and windows, letters
in upper case, digits, marks). On a bounded sample of labelled rows, sequential covering
grows one conjunction of thresholds at a time for the rejected class, by information gain
on two thirds of the rows, prunes it on the other third, and removes what it covers. The
list that results is an ordered Spark ``CASE WHEN`` over the measures: the first rule that
fits rejects the text, and what no rule fits is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labelled rows the list is learned from, at most; the rows with the smallest hashed ids are taken.
TRAIN_ROWS = 20_000
MIN_PRECISION = 0.95
MIN_COVERED = 8
MAX_CONDITIONS = 4
THRESHOLDS = 24

SPACES = b" \t\n\x0b\x0c\r"
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?^~=_+{}[]@\\"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_upper",
    "n_digits",
    "n_marks",
)
SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

# Features of the rules: a measure for every so many of another.
SHARES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    code = ids[:n]
    for k in range(1, width):
        # numbered anew at each step, so that codes stay below n * len(names)
        code = np.unique(code, return_inverse=True)[1] if k > 1 else code
        code = code * len(names) + ids[k : k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of MEASURES; all zero for NULL."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - count(SPACES),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        count(UPPER),
        count(DIGITS),
        count(MARKS),
    )


@F.pandas_udf(SCHEMA)
def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, above?, threshold) hold: reject. rejected/kept: rows of the pruning third it covers."""

    conditions: tuple[tuple[str, bool, float], ...]
    rejected: int
    kept: int

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def features(rows: pd.DataFrame) -> pd.DataFrame:
    shares = {name: rows[a] / rows[b].clip(lower=1) for name, (a, b) in SHARES.items()}
    return pd.DataFrame({"n_words": rows["n_words"].astype(float), **shares})


def cuts(values: np.ndarray) -> list[float]:
    """Thresholds at quantiles of the values, each moved to the middle of the gap above it."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return []
    at = np.quantile(values, np.linspace(0.005, 0.995, THRESHOLDS), method="lower")
    below = np.minimum(np.searchsorted(distinct, np.unique(at)), len(distinct) - 2)
    return [float(x) for x in np.unique((distinct[below] + distinct[below + 1]) / 2)]


def learn(
    table: pd.DataFrame,
    reject: np.ndarray,
    prune: np.ndarray,
    min_precision: float = MIN_PRECISION,
    min_covered: int = MIN_COVERED,
) -> list[Rule]:
    """Sequential covering. ``prune`` marks the rows that rules are pruned and judged on."""
    tests, holds = [], []
    for name in table.columns:
        values = table[name].to_numpy()
        for cut in cuts(values):
            tests += [(name, True, float(cut)), (name, False, float(cut))]
            holds += [values > cut, values <= cut]
    if not tests:
        return []
    matrix = np.array(holds, dtype=np.float32)
    rules: list[Rule] = []
    left = np.ones(len(table), dtype=bool)
    while True:
        grown = _grow(matrix, left & ~prune, reject, min_covered)
        kept = _prune(matrix, grown, left & prune, reject)
        if not kept:
            return rules
        covered = left & (matrix[kept].min(axis=0) > 0)
        bad, good = int((covered & prune & reject).sum()), int((covered & prune & ~reject).sum())
        if bad < min_covered / 2 or bad < min_precision * (bad + good):
            return rules
        rules.append(Rule(tuple(tests[i] for i in kept), bad, good))
        left &= ~covered


def _grow(matrix: np.ndarray, rows: np.ndarray, reject: np.ndarray, min_covered: int) -> list[int]:
    """Adds the condition of largest gain until no kept row is covered."""
    chosen: list[int] = []
    inside = rows.copy()
    while len(chosen) < MAX_CONDITIONS:
        p, n = (inside & reject).sum(), (inside & ~reject).sum()
        if p < min_covered or n == 0:
            break
        ps, ns = matrix @ (inside & reject).astype(np.float32), matrix @ (inside & ~reject).astype(np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ps * (np.log2((ps + 0.5) / (ps + ns + 1)) - np.log2((p + 0.5) / (p + n + 1)))
        gain[ps < min_covered] = -np.inf
        best = int(np.argmax(gain))
        if not gain[best] > 1e-9:
            break
        chosen.append(best)
        inside &= matrix[best] > 0
    return chosen


def _prune(matrix: np.ndarray, chosen: list[int], rows: np.ndarray, reject: np.ndarray) -> list[int]:
    """The shortest leading part of the conditions with the best worth on the pruning rows."""
    best, worth = [], -np.inf
    for size in range(1, len(chosen) + 1):
        covered = rows & (matrix[chosen[:size]].min(axis=0) > 0)
        p, n = (covered & reject).sum(), (covered & ~reject).sum()
        now = (p - n) / (p + n) if p + n else -np.inf
        if now > worth + 1e-9:
            best, worth = chosen[:size], now
    return best


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
    **options: float,
) -> list[Rule]:
    """Learns from ``train_rows`` labelled rows at most (label 0: reject). No labels, no rules.

    Rows with a NULL id or label teach nothing; an id labelled twice differently counts once per label.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).dropna().distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The sample is bounded by train_rows, hence the broadcast.
    taught = texts.join(F.broadcast(sample), "doc_id").select(
        "label", F.pmod(F.xxhash64("doc_id", F.lit("third")), F.lit(3)).alias("third"), measures("text").alias("m")
    )
    # Texts that fail the base rule are out before the list is asked, so they teach it nothing.
    passing = taught.filter(~base_failed(F.col("m")))
    rows = passing.select("label", "third", "m.*").toArrow().to_pandas().sort_values(["third", "label", *MEASURES])
    if rows.empty:
        return []
    return learn(features(rows), (rows["label"] == 0).to_numpy(), (rows["third"] == 0).to_numpy(), **options)


def _feature(m: Column, name: str) -> Column:
    if name not in SHARES:
        return m[name].cast("double")
    above, below = SHARES[name]
    return m[above] / F.greatest(m[below], F.lit(1))


def first_rule(rules: list[Rule], m: Column) -> Column:
    """The ordered conditional: the text of the first rule that fits, else NULL."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for name, above, cut in rule.conditions:
            fits = fits & ((_feature(m, name) > cut) if above else (_feature(m, name) <= cut))
        out = F.when(fits, str(rule)) if out is None else out.when(fits, str(rule))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, rule, kept. NULL texts have no words."""
    told = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text)).alias("m"))
    m = F.col("m")
    out = told.select("doc_id", "m.*", base_failed(m).alias("base_failed"), first_rule(rules, m).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    told = docs.select(F.struct("*").alias("row"), measures(F.col(text)).alias("m"))
    m = F.col("m")
    return told.filter(~base_failed(m) & first_rule(rules, m).isNull()).select("row.*")
