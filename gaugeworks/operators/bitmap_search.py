"""Boolean search on bitmaps: one set of bits per term, one plan for a whole table of requests.

Items are numbered in the order of the results and cut into buckets of some 16,000. For every term a
bucket holds the places of the items that have it: as a bitmap where they are many, as a list where
they are few. A request is a few clauses, each a set of terms of which one must match. Requests with
the same clauses, bounds and limit are one question, and clauses with the same terms are one set of
bits, so bits grow with the items and not with the requests. A question's bits are combined inside a
bucket: *and* over its required clauses, counting over its optional ones. As (bucket, place) is the
order of the results, a question's best places are known before any item is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import tokens
from gaugeworks.operators.dedup import top_per_group
from gaugeworks.session import materialize, remove, written

# Fixed value: the places one bitmap of Spark's functions covers.
BITMAP_PLACES = 32_768

# Half of the places, so that a bucket filled by hash does not overflow.
BUCKET_ITEMS = BITMAP_PLACES // 2
# More places than this and a bitmap is the smaller form.
LIST_PLACES = 1024
# Texts that a task holds at a time.
HELD_BYTES = 1 << 25

MUST, SHOULD = "must", "should"


# Questions that one task answers for a bucket at a time.
REQUEST_BLOCK = 1024


@dataclass(frozen=True)
class BitmapIndex:
    """``items`` (bucket, place, and the items' columns), in the order of results, and ``bits`` and ``lists`` of terms."""

    items: DataFrame
    bits: DataFrame
    lists: DataFrame


def numbered(items: DataFrame, item_id: str, buckets: int, order: Sequence[Column]) -> DataFrame:
    """Adds (bucket, place), ascending in the given order, the id last; places count up from 0 in each bucket.

    A range with more items than a bitmap has places goes on in the next buckets.
    """
    ranges = [*order, F.col(item_id).asc()]
    # the upper bits are the range, the lower ones count its rows
    number = F.monotonically_increasing_id()
    return (
        items.repartitionByRange(buckets, *ranges)
        .sortWithinPartitions(*ranges)
        .withColumn("_number", number)
        .withColumns({"bucket": F.floor(F.col("_number") / BITMAP_PLACES), "place": F.col("_number") % BITMAP_PLACES})
        .drop("_number")
    )


def _places_of_values(named: Sequence[tuple[str, bool]]):
    """Items (bucket, place, a column per field) -> (field, analysed, value, bucket, places), a bucket's worth of items at a time."""

    def gather(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(held).combine_chunks()
        numbers, bucket = np.unique(items.column("bucket").to_numpy(), return_inverse=True)
        place = items.column("place").to_numpy()
        for n, (field, analysed) in enumerate(named):
            column = pc.dictionary_encode(items.column(f"_{n}").combine_chunks())
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            has = np.flatnonzero(pc.is_valid(column.indices).to_numpy(zero_copy_only=False))
            if not len(has):
                continue
            code = column.indices.take(pa.array(has)).to_numpy().astype(np.int64)
            key = bucket[has] * len(column.dictionary) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts, len(key)].astype(np.int32)
            at, value = np.divmod(key[starts], len(column.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * len(starts), pa.string()),
                    pa.array([analysed] * len(starts), pa.bool_()),
                    column.dictionary.take(pa.array(value)).cast(pa.string()),
                    pa.array(numbers[at], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(place[has][order], pa.int16())),
                ],
                names=["field", "analysed", "value", "bucket", "places"],
            )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BITMAP_PLACES or size >= HELD_BYTES:
                yield from gather(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from gather(held)

    return places


def _as_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of places as bitmaps of the layout of Spark's bitmap functions."""
    for batch in batches:
        bits = []
        for places in batch.column("places"):
            held = np.zeros(BITMAP_PLACES, dtype=bool)
            held[places.values.to_numpy()] = True
            bits.append(np.packbits(held, bitorder="little").tobytes())
        kept = [batch.column(c) for c in ("field", "term", "bucket")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(bits, pa.binary())], names=["field", "term", "bucket", "bits"])


def write_bitmaps(
    items: DataFrame, item_id: str, texts: Sequence[str], keywords: Sequence[str], path: str, order: Sequence[Column]
) -> BitmapIndex:
    """Index ``items`` under ``path``: the tokens of ``texts``, the values of ``keywords`` as they are.

    ``order`` is the order of results; it should be total.

    Places of a term are gathered per bucket, so a term of all items is as many rows as there are
    buckets, and no row is longer than a bucket. Equal values that lie together are analysed once, and
    their places travel as one row. NULL texts and values have no terms.
    """
    spark = items.sparkSession
    # written, as they are counted, looked at for the ranges, and sorted
    plain, scratch = written(items)
    buckets = max(1, -(-plain.count() // BUCKET_ITEMS))
    numbered(plain, item_id, buckets, order).write.mode("overwrite").parquet(f"{path}/items")
    remove(spark, scratch)
    stored = spark.read.parquet(f"{path}/items")
    named = [(t, True) for t in texts] + [(k, False) for k in keywords]
    sources = [F.col(n).cast("string").alias(f"_{i}") for i, (n, _) in enumerate(named)]
    valued = stored.select("bucket", F.col("place").cast("smallint").alias("place"), *sources).mapInArrow(
        _places_of_values(named), "field string, analysed boolean, value string, bucket long, places array<smallint>"
    )
    words = F.when(F.col("analysed"), F.array_distinct(tokens("value"))).otherwise(F.array("value"))
    terms = valued.select("field", F.explode(words).alias("term"), "bucket", "places")
    # the term leads, as sorts compare the first key's prefix before anything else
    gathered = materialize(terms.groupBy("term", "bucket", "field").agg(F.flatten(F.collect_list("places")).alias("places")))
    few = F.size("places") <= LIST_PLACES
    gathered.filter(few).select("field", "term", "bucket", "places").write.mode("overwrite").parquet(f"{path}/lists")
    (
        gathered.filter(~few)
        .select("field", "term", "bucket", "places")
        .mapInArrow(_as_bits, "field string, term string, bucket long, bits binary")
        .write.mode("overwrite")
        .parquet(f"{path}/bits")
    )
    return read_bitmaps(spark, path)


def read_bitmaps(spark: SparkSession, path: str) -> BitmapIndex:
    return BitmapIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("items", "bits", "lists")])


def clause_bits(index: BitmapIndex, clauses: DataFrame) -> DataFrame:
    """(clause, bucket, bits) of ``clauses`` (clause, field, term).

    A clause's bits are the union over its terms; buckets without a match have no row.
    """
    keys = ["clause", "bucket"]
    wide = clauses.join(index.bits, ["field", "term"]).select(*keys, "bits")
    narrow = (
        clauses.join(index.lists, ["field", "term"])
        .select(*keys, F.explode(F.col("places").cast("array<bigint>")).alias("place"))
        .groupBy(*keys)
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    return wide.unionByName(narrow).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def told_apart(df: DataFrame, number: str) -> DataFrame:
    """The distinct rows of ``df`` (one column), numbered, as a written table."""
    return materialize(df.distinct().withColumn(number, F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Questions:
    """What requests have in common.

    ``asked`` (request, question); ``questions`` (question, required, optional, least, settings): the
    two are clause numbers; ``clauses`` (clause, field, term).
    """

    asked: DataFrame
    questions: DataFrame
    clauses: DataFrame


def questions_of(requests: DataFrame, clauses: DataFrame, settings: Sequence[str]) -> Questions:
    """Equal requests become one question, clauses with equal terms one clause."""
    terms = F.to_json(F.sort_array(F.collect_set(F.struct("field", "term"))))
    stated = materialize(clauses.groupBy("request", "clause", "occurs").agg(terms.alias("terms")))
    numbers = told_apart(stated.select("terms"), "number")
    held = stated.join(numbers, "terms").groupBy("request").agg(
        # the same terms may be asked for twice, and then count twice
        *[F.sort_array(F.collect_list(F.when(F.col("occurs") == o, F.col("number")))).alias(n) for o, n in ((MUST, "required"), (SHOULD, "optional"))]
    )
    none = F.array().cast("array<bigint>")
    asked = requests.select("request", F.coalesce("least_should", F.lit(0)).cast("int").alias("least"), *settings).join(held, "request", "left")
    parts = [F.coalesce("required", none).alias("required"), F.coalesce("optional", none).alias("optional"), "least", *settings]
    asked = materialize(asked.select("request", F.struct(*parts).alias("parts")).withColumn("_same", F.to_json("parts")))
    named = told_apart(asked.select("_same"), "question")
    spelled = asked.schema["parts"].dataType.simpleString()
    entries = F.from_json("terms", "array<struct<field:string,term:string>>")
    return Questions(
        asked.join(named, "_same").select("request", "question"),
        named.select("question", F.from_json("_same", spelled).alias("parts")).select("question", "parts.*"),
        numbers.select(F.col("number").alias("clause"), F.inline(entries)),
    )


def _bools(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)


def _by_place(asked: pa.Table, rows: np.ndarray, places: np.ndarray) -> pa.Table:
    """(questions, bucket, place): row ``rows[i]`` of a bucket's questions takes place ``places[i]``."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]][: len(places)])
    ends = np.r_[starts, len(places)].astype(np.int32)
    questions = asked.column("question").combine_chunks().take(pa.array(rows[order]))
    if isinstance(questions, pa.ChunkedArray):
        questions = questions.combine_chunks()
    bucket = asked.column("bucket").take(pa.array(rows[order][starts]))
    listed = pa.ListArray.from_arrays(pa.array(ends), questions)
    return pa.table({"questions": listed, "bucket": bucket, "place": pa.array(places[starts], pa.int64())})


def _answer(at_most: Mapping[str, str], at_least: Mapping[str, str], limit: str | None, together: bool):
    """The places of a bucket that each question takes: (its questions and clauses, its numbers) -> (question, bucket, place).

    ``together`` gives a place once, with all its questions: (questions, bucket, place).
    """

    def answer(asked: pa.Table, numbers: pa.Table) -> pa.Table:
        place = numbers.column("place").to_numpy()
        present = np.zeros(BITMAP_PLACES, dtype=bool)
        present[place] = True
        values = {}
        for name in {*at_most, *at_least}:
            values[name] = np.full(BITMAP_PLACES, np.nan)
            values[name][place] = numbers.column(name).to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
        is_clause = pc.is_valid(asked.column("clause"))
        held = asked.filter(is_clause)
        bits = {c: _bools(b) for c, b in zip(held.column("clause").to_pylist(), held.column("bits").to_pylist(), strict=True)}
        asked = asked.filter(pc.invert(is_clause)).drop_columns(["clause", "bits"])
        none = np.zeros(0, dtype=np.int64)
        rows, taken = [], []
        for n, row in enumerate(asked.to_pylist()):
            if any(c not in bits for c in row["required"]):
                continue
            found = present
            for c in row["required"]:
                found = found & bits[c]
            if row["least"] > 0:
                met = np.zeros(BITMAP_PLACES, dtype=np.int32)
                for c in row["optional"]:
                    if c in bits:
                        met += bits[c]
                found = found & (met >= row["least"])
            places = np.flatnonzero(found)
            for bounds, within in ((at_most, np.less_equal), (at_least, np.greater_equal)):
                for name, bound in bounds.items():
                    if row[bound] is not None:
                        places = places[within(values[name][places], float(row[bound]))]
            if limit is not None and row[limit] is not None:
                places = places[: row[limit]]
            rows.append(np.full(len(places), n, dtype=np.int64))
            taken.append(places)
        if together:
            return _by_place(asked, np.concatenate([none, *rows]), np.concatenate([none, *taken]))
        source = asked.select(["question", "bucket"]).take(pa.array(np.concatenate([none, *rows])))
        return source.append_column("place", pa.array(np.concatenate([none, *taken])))

    return answer


def matches(
    index: BitmapIndex,
    asked: Questions,
    at_most: Mapping[str, str] | None = None,
    at_least: Mapping[str, str] | None = None,
    limit: str | None = None,
    together: bool = False,
) -> DataFrame:
    """(question, bucket, place) of the items each question asks for, at most ``limit`` of each bucket.

    ``together`` gives (questions, bucket, place): one row per item and block of questions, not one per question.

    A question without a required clause, and with no optional one it insists on, asks for all items.
    ``at_most`` and ``at_least`` name a column of the questions for a number of the items; NULL sets no
    bound, and an item without the number is within none. ``limit`` names a column, too.
    """
    at_most, at_least = dict(at_most or {}), dict(at_least or {})
    questions = asked.questions
    blocks = max(1, -(-questions.count() // REQUEST_BLOCK))
    placed = questions.withColumn("block", F.pmod(F.xxhash64("question"), F.lit(blocks)))
    used = placed.select("block", F.explode(F.array_distinct(F.concat("required", "optional"))).alias("clause")).distinct()
    bits = clause_bits(index, asked.clauses).join(used, "clause")
    # every question goes to every bucket, as a few numbers; bits go once to a bucket and block
    buckets = materialize(index.items.select("bucket").distinct())
    everywhere = placed.crossJoin(buckets)
    told = everywhere.unionByName(bits, allowMissingColumns=True)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    numbers = index.items.select("bucket", "place", *sorted({*at_most, *at_least}), every)
    told_by = "questions array<long>" if together else "question long"
    return (
        told.groupBy("bucket", "block")
        .cogroup(numbers.groupBy("bucket", "block"))
        .applyInArrow(_answer(at_most, at_least, limit, together), f"{told_by}, bucket long, place long")
    )


def search_batch(
    index: BitmapIndex,
    requests: DataFrame,
    clauses: DataFrame,
    at_most: Mapping[str, str] | None = None,
    at_least: Mapping[str, str] | None = None,
    limit: str | None = None,
) -> DataFrame:
    """The matching items of every request as (request, rank, the items' columns); see ``matches``.

    ``limit`` names the column of ``requests`` that says how many items a request wants, best first in
    the order of the index. A request without one is answered in full, without ranks.
    """
    columns = [c for c in index.items.columns if c not in ("bucket", "place")]
    settings = sorted({*(at_most or {}).values(), *(at_least or {}).values(), *([limit] if limit else [])})
    asked = questions_of(requests, clauses, settings)
    places = matches(index, asked, at_most, at_least, limit, together=limit is None)
    unranked = F.lit(None).cast("int").alias("rank")
    if limit is None:
        # an item is looked up once, whatever the number of questions that take it
        looked_up = places.join(index.items, ["bucket", "place"]).withColumn("question", F.explode("questions"))
        return looked_up.join(asked.asked, "question").select("request", unranked, *columns)
    most = requests.agg(F.max(limit)).first()[0] or 0
    found = places.join(asked.questions.select("question", F.col(limit).alias("_wish")), "question")
    unlimited = asked.questions.filter(F.col(limit).isNull()).limit(1).count() > 0
    if unlimited:
        found = materialize(found)
    best = top_per_group(found.filter("_wish is not null"), ["question"], [F.col("bucket").asc(), F.col("place").asc()], most)
    ranked = best.filter("rank <= _wish").select("question", "rank", "bucket", "place")
    chosen = ranked
    if unlimited:
        chosen = ranked.unionByName(found.filter("_wish is null").select("question", unranked, "bucket", "place"))
    return chosen.join(index.items, ["bucket", "place"]).join(asked.asked, "question").select("request", "rank", *columns)


def clause_of(requests: DataFrame, clause: int, occurs: str, text: str, fields: Sequence[str]) -> DataFrame:
    """One clause a request: any token of column ``text`` in any of ``fields``. A NULL text makes no clause.

    A text without a token makes a clause that nothing matches, as a text query of blanks does.
    """
    named = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")
    words = tokens(text)
    terms = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("\0")))
    return (
        requests.filter(F.col(text).isNotNull())
        .select("request", F.lit(clause).alias("clause"), F.lit(occurs).alias("occurs"), named, F.explode(terms).alias("term"))
    )


def keyword(requests: DataFrame, clause: int, occurs: str, value: Column, field: str) -> DataFrame:
    """One clause a request: ``field`` has exactly this value. A NULL value makes no clause."""
    return requests.select(
        "request", F.lit(clause).alias("clause"), F.lit(occurs).alias("occurs"), F.lit(field).alias("field"), value.cast("string").alias("term")
    ).filter(F.col("term").isNotNull())


def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_evidence_batch(index: BitmapIndex, requests: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Evidence search for a table of requests; see ``operators.search.search_evidence`` for one.

    ``requests`` has request, query, target_chembl_id, target_name, standard_type, max_value_nm,
    min_confidence and hits; NULL in any of them asks for nothing, and NULL hits for all. ``fields``
    names the searched columns of "query" and "target".
    """
    clauses = [
        clause_of(requests, 0, MUST, "query", fields["query"]),
        clause_of(requests.filter("target_chembl_id is null"), 1, MUST, "target_name", fields["target"]),
        keyword(requests, 2, MUST, F.col("target_chembl_id"), "target_chembl_id"),
        keyword(requests, 3, MUST, F.col("standard_type"), "standard_type"),
    ]
    asked = requests.select("request", F.lit(0).alias("least_should"), "max_value_nm", "min_confidence", "hits")
    at_most, at_least = {"standard_value_nm": "max_value_nm"}, {"confidence_score": "min_confidence"}
    return search_batch(index, asked, union_of(clauses), at_most, at_least, "hits")
