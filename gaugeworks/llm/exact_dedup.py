"""Exact dedup with an extendible-hash index on shared files.

Every text gets a key: the 64-bit hash of its normalised form. A directory maps the
leading bits of a key to a bucket. It starts with one slot; while a bucket holds more
entries than its capacity and its keys still differ in a bit, the directory doubles and
that bucket splits in two. The index is one Parquet table of entries, written so that one
task owns one range of buckets, beside one small Parquet table with the directory.

An entry is one distinct text: its key, its SHA-256, the smallest document id that has it
and the number of rows. Texts of one key are told apart byte by byte: they are grouped by
key *and* bytes, so a key that two texts share becomes a chain of two entries. Only texts
whose key occurs more than once are shuffled for that, and each task sends one row per
distinct text, however hot it is.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE
from gaugeworks.session import materialize

KEY_BITS = 64
CAPACITY = 65_536
HISTOGRAM_BITS = 16


@dataclass(frozen=True)
class Index:
    """entries: bucket, key, text_sha256, keep_id, group_size. directory: depth, slot, entries.

    rows: doc_id, key, text_sha256 of every row that was indexed.
    """

    entries: DataFrame
    directory: DataFrame
    rows: DataFrame


def normalised(text: str) -> Column:
    """White space runs become one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _key(text: Column, bits: int) -> Column:
    """The leading ``bits`` bits of the hash; fewer than 64 only to provoke collisions in tests."""
    spare = KEY_BITS - bits
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), spare), spare) if spare else F.xxhash64(text)


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of the key."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def split_directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = HISTOGRAM_BITS) -> DataFrame:
    """Doubles the directory until no bucket is overfull: rows (depth, slot, entries).

    ``keys`` holds one row per entry with its ``key``. The counts are taken once at the
    deepest level (2**bits rows at most) and each doubling reads only that histogram. A
    bucket that is still overfull at the deepest level stays one bucket and its entries
    chain.
    """
    deepest = materialize(keys.groupBy(_slot(F.col("key"), bits).alias("leaf")).agg(F.count("*").alias("n")))
    settled, open_slots, depth = None, None, 0
    while True:
        level = deepest.groupBy(F.shiftrightunsigned("leaf", bits - depth).alias("slot")).agg(
            F.sum("n").alias("entries")
        )
        if open_slots is not None:
            parents = open_slots.select(F.col("slot").alias("parent"))
            level = level.join(parents, F.shiftright(F.col("slot"), 1) == F.col("parent"), "left_semi")
        full = (F.col("entries") > capacity) & F.lit(depth < bits)
        level = level.select(F.lit(depth).alias("depth"), "slot", "entries", full.alias("full"))
        if depth:
            level = materialize(level)
        done = level.filter(~F.col("full")).drop("full")
        settled = done if settled is None else settled.unionByName(done)
        open_slots = level.filter("full")
        if depth == bits or open_slots.isEmpty():
            return settled
        depth += 1


def build_index(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    key_bits: int = KEY_BITS,
    capacity: int = CAPACITY,
) -> Index:
    """Reads every row and whole text once, and the texts of repeated keys once more.

    NULL texts count as empty; an empty table gives an empty index; a NULL id takes part
    and is the smallest id only where a group has no other. Extra columns are not read.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    keyed = plain.select("doc_id", "norm", _key(F.col("norm"), key_bits).alias("key"))
    rows = materialize(keyed.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")))

    # Every task sums its own rows first, so a hot text is one row per task.
    tallied = materialize(
        rows.groupBy("key", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    repeated = tallied.groupBy("key").agg(F.sum("group_size").alias("n")).filter("n > 1").select("key")
    single = tallied.join(repeated, "key", "left_anti")
    chained = (
        keyed.join(repeated, "key", "left_semi")
        .groupBy("key", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    entries = materialize(single.unionByName(chained))
    directory = split_directory(entries.select("key"), capacity)

    # The directory has 2**HISTOGRAM_BITS slots at most: that bounds what is broadcast here.
    span = F.expr(f"shiftleft(1L, {HISTOGRAM_BITS} - depth)")
    first = F.col("slot") * span
    leaves = directory.select(first.alias("bucket"), F.explode(F.sequence(first, first + span - 1)).alias("leaf"))
    placed = (
        entries.withColumn("leaf", _slot(F.col("key"), HISTOGRAM_BITS)).join(F.broadcast(leaves), "leaf").drop("leaf")
    )
    owned = materialize(placed.repartition("bucket").sortWithinPartitions("bucket", "key", "text_sha256"))
    return Index(owned, directory, rows)


def probe(index: Index) -> DataFrame:
    """One row per document of the indexed table: doc_id, keep_id, group_size, kept, text_sha256.

    A row finds its chain by key and its entry in the chain by SHA-256. Two texts of one
    key *and* one SHA-256 would be two entries with different bytes; that raises.

    Rows that repeat the smallest id of their group are all marked as kept;
    ``drop_copies`` then takes one of them.
    """
    chain = index.entries.groupBy("key", "text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
    )
    checked = chain.select(
        "key",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
        .otherwise(F.col("text_sha256"))
        .alias("text_sha256"),
        "keep_id",
        "group_size",
    )
    alone = F.col("group_size") == 1
    found = index.rows.join(checked, ["key", "text_sha256"])
    kept = alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    return probe(build_index(docs, doc_id, text, **options))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts, one row with the smallest id.

    Ids may repeat: a row stays when its id and its text's SHA-256 are those of a kept
    entry, and of such rows one is taken.
    """
    kept = exact_groups(docs, doc_id, text, **options).filter("kept")
    kept = kept.select(F.struct("doc_id", "text_sha256").alias("mark"))
    mark = F.struct(F.col(doc_id).alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"))
    tagged = docs.select(F.struct("*").alias("row"), mark.alias("mark"))
    return tagged.join(kept, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*")
