"""Vector code compression: product codes learned by Lloyd rounds in which members stay resident.

Every vector is cut into parts. A part is a member of an owner (position, entry, salt), and the
members of an owner lie together in shared files. A round updates the entries from the resident
members, sends the small codebooks round, and assigns every member in place: a member that keeps
its entry is written where it is, and only members that change entry go through the shuffle to
their new owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import sized
from gaugeworks.session import materialize, remove, written

# Scale of the integer components, parts a vector, entries a part, rounds.
SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

# Members an owner holds even if all vectors share an entry; more make more salts.
OWNER_MEMBERS = 1024
PARTITION_MEMBERS = 100_000
# Components below this keep every sum of squares exact in 64 bits.
LARGEST = 1 << 15

MEMBER = "row long, pos int, entry int, x array<int>"

# Codebooks: one integer matrix (entries, width) per position.
Codebooks = list[np.ndarray]


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, x): vectors with finite components only, as floor(4096 * x).

    ``rows`` has vec_id, embedding and label; other columns are not read. Rows whose vector is
    NULL, empty, or holds a NULL, NaN or infinite component are dropped. A component of 2^15
    or more in size is an error: its squares would leave the 64-bit integers.
    """

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def scaled(x: Column) -> Column:
        value = x.cast("double")
        return F.when(F.abs(value) < LARGEST, F.floor(value * SCALE).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component is {LARGEST} or more in size")).cast("int")
        )

    kept = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", usable))
    numbered = kept.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("embedding", scaled).alias("x")
    )
    return materialize(numbered)


def first_codebooks(vectors: DataFrame) -> Codebooks:
    """The parts of the vectors with the 16 smallest ids, ascending; equal ids by their components.

    A NULL id counts as the largest. Fewer vectors make fewer entries, none make no codebooks.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    first = vectors.select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not first:
        return []
    dim = len(first[0]["x"])
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components cannot be cut into {PARTS} equal parts")
    chosen = vectors.filter(F.size("x") == dim).select("vec_id", "x").orderBy(*order).limit(ENTRIES).collect()
    matrix = np.array([r["x"] for r in chosen], dtype=np.int64).reshape(len(chosen), PARTS, dim // PARTS)
    return [matrix[:, pos] for pos in range(PARTS)]


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``x``, exact; ties go to the lower entry."""
    best = np.zeros(len(x), dtype=np.int64)
    least = None
    for entry, centre in enumerate(codebook):
        off = x - centre
        distance = np.einsum("ij,ij->i", off, off)
        if least is None:
            least = distance
        else:
            closer = distance < least
            best[closer] = entry
            least = np.where(closer, distance, least)
    return best, least if least is not None else np.zeros(len(x), dtype=np.int64)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1).astype(np.int32)))


def _assigned(batch: pa.RecordBatch, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of every member of a batch, position by position."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False)
    x = _matrix(batch.column("x"), batch.num_rows)
    entry = np.zeros(batch.num_rows, dtype=np.int64)
    distance = np.zeros(batch.num_rows, dtype=np.int64)
    for p in np.unique(pos):
        mine = np.flatnonzero(pos == p)
        entry[mine], distance[mine] = nearest(x[mine], codebooks[p])
    return entry, distance


def cut(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Members (row, pos, entry, x): the parts of every vector at their first entry."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row")
            matrix = _matrix(batch.column("x"), batch.num_rows)
            width = matrix.shape[1] // PARTS
            for pos, codebook in enumerate(codebooks):
                part = matrix[:, pos * width : (pos + 1) * width]
                entry, _ = nearest(part, codebook)
                here = np.full(len(part), pos, dtype=np.int32)
                columns = [row, pa.array(here), pa.array(entry.astype(np.int32)), _lists(np.ascontiguousarray(part))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "pos", "entry", "x"])

    return vectors.select("row", "x").mapInArrow(parts, MEMBER)


def dealt(members: DataFrame, n_vectors: int) -> DataFrame:
    """Members together with their owner (position, entry, salt).

    The salts follow the number of vectors, so an entry that all of them share is still many owners.
    """
    salt = F.pmod(F.xxhash64("row"), F.lit(sized(n_vectors, OWNER_MEMBERS)))
    return members.repartition(sized(n_vectors * PARTS, PARTITION_MEMBERS), "pos", "entry", salt)


def updated(residents: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Entries as the floor of their members' means; an entry without members stays.

    A task adds up its resident members and emits one row per entry it holds; these are added up
    by a shuffle. To the driver come positions x entries rows, whatever the number of members.
    """
    width = codebooks[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * ENTRIES, width), dtype=np.int64)
        members = np.zeros(PARTS * ENTRIES, dtype=np.int64)
        for batch in batches:
            slot = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64) * ENTRIES
            slot += batch.column("entry").to_numpy(zero_copy_only=False)
            np.add.at(total, slot, _matrix(batch.column("x"), batch.num_rows) if batch.num_rows else total[:0])
            members += np.bincount(slot, minlength=PARTS * ENTRIES)
        held = np.flatnonzero(members)
        offsets = pa.array(np.arange(0, held.size * width + 1, width, dtype=np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(total[held].reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array((held // ENTRIES).astype(np.int32)), pa.array((held % ENTRIES).astype(np.int32)), pa.array(members[held]), lists],
            names=["pos", "entry", "members", "sums"],
        )

    partial = residents.mapInArrow(sums, "pos int, entry int, members long, sums array<long>")
    added = partial.groupBy("pos", "entry").agg(
        F.sum("members").alias("members"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )
    after = [codebook.copy() for codebook in codebooks]
    for r in added.collect():
        after[r["pos"]][r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["members"]
    return after


def reassigned(residents: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Members at their nearest entry, with ``moved``: whether that is another one than before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entry, _ = _assigned(batch, codebooks)
                moved = entry != batch.column("entry").to_numpy(zero_copy_only=False)
                columns = [batch.column("row"), batch.column("pos"), pa.array(entry.astype(np.int32)), batch.column("x"), pa.array(moved)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "pos", "entry", "x", "moved"])

    return residents.mapInArrow(assign, f"{MEMBER}, moved boolean")


def lloyd(vectors: DataFrame, codebooks: Codebooks, n_vectors: int, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` updates, and the members as they were dealt for the last one.

    Each generation of members is in the shared folder, so a lost executor repeats a task, not the
    rounds; the generation before goes as soon as its successor is written. Rounds end early only
    at a fixed point, where no further one would change anything.
    """
    spark = vectors.sparkSession
    residents, path = written(dealt(cut(vectors, codebooks), n_vectors))
    paths = [path]
    for turn in range(rounds):
        before, codebooks = codebooks, updated(residents, codebooks)
        if all(np.array_equal(a, b) for a, b in zip(before, codebooks)):
            break
        if turn == rounds - 1:
            break
        judged, stayed = written(reassigned(residents, codebooks), "moved")
        moving = judged.filter("moved").drop("moved")
        arrived, came = written(dealt(moving, n_vectors))
        for path in paths:
            remove(spark, path)
        paths = [stayed, came]
        residents = judged.filter("not moved").drop("moved").unionByName(arrived)
    return codebooks, residents


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position within the part."""
    components = [str(int(c)) for codebook in codebooks for c in codebook.reshape(-1)]
    return hashlib.sha256(",".join(components).encode()).hexdigest()


def coded(vectors: DataFrame, members: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the final entries of each vector, one row per row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entry, distance = _assigned(batch, codebooks)
                columns = [batch.column("row"), batch.column("pos"), pa.array(entry.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "pos", "entry", "error"])

    scored = members.mapInArrow(score, "row long, pos int, entry int, error long")
    named = vectors.select("row", "vec_id", "label")
    rows = named.unionByName(scored, allowMissingColumns=True)
    entries = [F.max(F.when(F.col("pos") == p, F.col("entry"))) for p in range(PARTS)]
    digits = [F.lower(F.lpad(F.hex(e), 2, "0")) for e in entries]
    return rows.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"),
        F.max("label").alias("label"),
        F.concat(*digits).alias("code"),
        F.sum("error").alias("error"),
    )


def compress(rows: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per usable row of ``rows``.

    Vectors must be as long as that of the smallest kept id; others are left out like broken ones.
    Repeated rows are rows of their own, with equal codes. An empty table gives no rows. Errors are
    added up by label before they are joined back, and rows without a label are one label.
    """
    vectors = integer_vectors(rows)
    codebooks = first_codebooks(vectors)
    if codebooks:
        dim = PARTS * codebooks[0].shape[1]
        vectors = vectors.filter(F.size("x") == dim)
        codebooks, members = lloyd(vectors, codebooks, vectors.count())
        out = materialize(coded(vectors, members, codebooks).drop("row"))
    else:
        out = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    totals = materialize(out.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of_label")
    return out.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
