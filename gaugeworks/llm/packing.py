"""Packing token sequences by best-fit decreasing.

Texts are tokenised where they lie. A document longer than a window is first cut into full
windows, each a sequence of its own; what is left over, and every shorter document, is a
piece to pack. Pieces are dealt at random into groups of a fixed expected size; each group
is sorted by falling length, and every piece goes into the open window with the least room
that still holds it. A segment tree over remaining capacities finds that window in
log(window) steps. One task holds one group's lengths, never texts or ids.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import materialize

WINDOW = 4096
END = 2
# Pieces packed together in one task, on average.
GROUP_PIECES = 50_000
# Words a worker remembers the ids of, and as many parts of words; those met later are looked up anew.
REMEMBERED = 60_000
GROUP_STRIDE = 1 << 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: a byte that prints stands for
    itself, the others are numbered from code point 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """Values by key, computed when first asked for; the first REMEMBERED of them are kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


class WordIds:
    """Ids of a text, word by word: what stands between ASCII white space is tokenised alone.

    That gives what the tokenizer gives for the whole text when its normaliser and its
    pre-tokenizer never join across white space, as here. The ids of a word are remembered as
    bytes. A word of plain Latin letters with punctuation after it is looked up as the two
    parts that the pre-tokenizer makes of it; any other word goes through the tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#*%$&|]*)\Z")
    LETTERS = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self._word)
        self.parts = Remembered(self._part)

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        known = part if part.isascii() else "".join(self.LETTERS[b] for b in part.encode())
        return _raw([t.id for t in self.model.tokenize(known)])

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        plain = self.PLAIN.match(word)
        if plain:
            letters, marks = plain.groups()
            return self.parts[letters.lower()] + self.parts[marks]
        return _raw(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenise(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian, NULL unless kept).

    NULL and empty texts are the end id alone. Every row gives its own pieces, also where ids repeat.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _word_ids(tokenizer)
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(value or "") + END.to_bytes(4, "little")
                for start in range(0, len(ids), 4 * window):
                    raw = ids[start : start + 4 * window]
                    rows.append((key, start // 4, len(raw) // 4, zlib.crc32(raw), len(ids) // 4, raw if keep_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInPandas(_nullable(cut), PIECES)


def _nullable(fn):
    """Ids arrive as floats where a batch has NULLs; they are made whole again."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return fn(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches)

    return wrapped


class OpenWindows:
    """A segment tree over remaining capacities 0..window: each node counts the open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        self._add(room, 1)

    def tightest(self, length: int) -> int:
        """The least room >= length that an open window has, or -1."""
        node, count = length + self.leaves, self.count
        if count[node]:
            return length
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not count[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every length, which come in falling order."""
    tree, opened = OpenWindows(window), 0
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room < 0:
            room, name = window, opened
            opened += 1
        else:
            name = tree.take(room)
        sequence[i], offset[i] = name, window - room
        if room > length:
            tree.put(room - length, name)
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES, seed: int = 5) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), which are read twice.

    Full windows are sequences of their own; the others are dealt by a hash of their row and its
    place into groups, so equal rows and rows without an id spread like any others. A sequence's
    pieces lie gapless from offset 0. No pieces, no sequences.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    columns = [c for c in pieces.columns if c != "ids"]
    dealt = pieces.select(*columns).withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_group")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        sequence, offset = best_fit(group["length"].to_numpy(), window)
        return group.assign(sequence_id=group["_group"] * GROUP_STRIDE + sequence, offset=offset).drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(one, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array<long>), n_tokens. A sequence's pieces are window tokens at most.

    ``pieces`` still has the ids. Pieces of rows that repeat an id are told apart by their checksum.
    """
    key = ["doc_id", "start", "length", "ids_crc32"]
    ids = pieces.dropDuplicates(key).select(*[F.col(c).alias(f"_{c}") for c in key], "ids")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    whole = (
        packed.join(ids, same)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    )
    raw = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    digits = F.hex(raw)
    at = lambda i: F.concat(*[F.substring(digits, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    steps = F.sequence(F.lit(0), (F.col("n_tokens") - 1).cast("int"))
    return whole.select("sequence_id", "n_tokens", F.transform(steps, lambda i: F.conv(at(i), 16, 10).cast("long")).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options: int) -> DataFrame:
    """Pieces of all documents with their places: texts are tokenised once, then only numbers move."""
    pieces = tokenise(docs, tokenizer or default_tokenizer(), doc_id, text, window, keep_ids=False).drop("ids")
    return pack(materialize(pieces), window, **options)
