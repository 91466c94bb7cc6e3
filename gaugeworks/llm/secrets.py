"""Secret scan with corpus-wide ownership frequency.

Base spans come from three patterns. Further candidates are passwords inside urls, signed
tokens, and key-like strings: long runs of letters and digits that mix upper case, lower case
and digits. For the hash of every value, base or further, the whole corpus is counted: in how
many distinct repositories and with how many distinct owners does it occur? A value that many
owners share, or that one owner has in many repositories, is a copied example; a value that
one owner alone uses, in few repositories, looks live. Every span gets its two counts and that
verdict; further candidates become spans only if they look live.

A document's text stands for its repository, so exact copies of a file are one repository.
Counts are taken in three steps (value, owner, repository), each summed inside the tasks
before it is shuffled, so that a value in a third of all rows is a row per task.

Only DataFrame functions are used. Positions are code points, ends exclusive. NULL texts count
as empty, a NULL owner is an owner of its own, rows that repeat an id are scanned each on their
own, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import materialize

# The base kinds in their order, with pattern, the group measured and its least length.
KINDS = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Further shapes in their order. Of spans that overlap, the first shape's stays.
FURTHER = (
    ("url", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@?#]*:([^\s/:@?#]+)@", 1, 6),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("key", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
# A value is live while no more owners than this have it, in no more repositories than this.
MAX_OWNERS = 1
MAX_REPOSITORIES = 10


# Matches whose positions are summed one by one; what is longer is summed by chunks of so many.
CHUNK = 512


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, whatever their length.

    What lies between the matches and the matches themselves tile the text; running lengths
    give the positions: first inside chunks of matches, then over the chunks.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    no_spans = F.array().cast("array<struct<start:int,end:int,value:string>>")
    no_parts = F.array().cast("array<array<struct<start:int,end:int,value:string>>>")

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["gap"])
        end = begin + F.length(p["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def chunks(all_pieces: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_pieces) / CHUNK).cast("int") - 1, F.lit(0))
        start = F.struct(F.lit(0).alias("at"), no_spans.alias("spans"))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda c: F.aggregate(F.slice(all_pieces, c * CHUNK + 1, F.lit(CHUNK)), start, step),
        )

    def join(a: Column, c: Column) -> Column:
        moved = F.transform(
            c["spans"],
            lambda s: F.struct(
                (s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value")
            ),
        )
        return F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["parts"], F.array(moved)).alias("parts"))

    # The one-element array has the pieces computed once, not once for every chunk.
    chunked = F.element_at(F.transform(F.array(pieces), chunks), 1)
    begin = F.struct(F.lit(0).alias("at"), no_parts.alias("parts"))
    return F.aggregate(chunked, begin, join, lambda a: F.flatten(a["parts"]))


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Matches that are long enough, as array<struct<start, rank, kind, end, value>>; a quick test comes first."""
    long_enough = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    shaped = F.transform(
        long_enough,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("rank"),
            F.lit(kind).alias("kind"),
            m["end"].alias("end"),
            m["value"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    return F.when(text.rlike(pattern), shaped).otherwise(none)


def _key_like(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def _outside(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def _all_outside(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: _outside(s, others))


NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """doc_id, owner, repository, base, more: every base span and every further candidate of every whole text."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    base = F.concat(*[_spans(F.col("text"), k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])
    shapes = [_spans(F.col("text"), k, len(KINDS) + i, p, g, n) for i, (k, p, g, n) in enumerate(FURTHER)]
    found = plain.select("doc_id", "owner", "text", base.alias("base"), *[s.alias(f"more_{i}") for i, s in enumerate(shapes)])
    more = F.array().cast(NO_SPANS)
    for i, (kind, *_) in enumerate(FURTHER):
        wanted = F.col(f"more_{i}")
        if kind == "key":
            wanted = F.filter(wanted, lambda m: _key_like(m["value"]))
        more = F.concat(more, _all_outside(wanted, F.concat("base", more)))
    return found.withColumn("more", more).select(
        "doc_id",
        "owner",
        F.when(F.size(F.concat("base", "more")) > 0, F.sha2("text", 256)).alias("repository"),
        "base",
        "more",
    )


def ownership(found: DataFrame) -> DataFrame:
    """One row per value's hash: value_sha256, repositories, owners."""
    value = F.explode(F.concat("base.value", "more.value"))
    seen = found.select("owner", "repository", value.alias("value"))
    seen = seen.select(F.sha2("value", 256).alias("value_sha256"), "owner", "repository")
    each = seen.groupBy("value_sha256", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = each.groupBy("value_sha256", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_sha256").agg(
        F.sum("repositories").alias("repositories"), F.count("*").alias("owners")
    )


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, added, told.

    base: the base spans, by start and then kind. added: further candidates that look live,
    which is when no more than ``max_owners`` owners have the value, in no more than
    ``max_repositories`` repositories. Both are array<struct<start, rank, kind, end, value>>.
    told: base and added spans in order, with owners, repositories and live instead of the
    value. A text without a span has empty arrays.
    """
    found = materialize(scan(docs, doc_id, text, owner).withColumn("row", F.monotonically_increasing_id()))
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    counted = ownership(found).withColumn("live", few)
    spans = found.select("row", F.explode(F.concat("base", "more")).alias("span"))
    judged = spans.withColumn("value_sha256", F.sha2("span.value", 256)).join(counted, "value_sha256")
    shown = judged.filter((F.col("span.rank") < len(KINDS)) | F.col("live"))
    place = [F.col(f"span.{c}").alias(c) for c in ("start", "rank", "kind", "end")]
    told = F.array_sort(F.collect_list(F.struct(*place, "owners", "repositories", "live")))
    extra = F.when(F.col("span.rank") >= len(KINDS), F.col("span"))
    by_row = shown.groupBy("row").agg(told.alias("told"), F.array_sort(F.collect_list(extra)).alias("added"))
    no_told = "array<struct<start:int,rank:int,kind:string,end:int,owners:bigint,repositories:bigint,live:boolean>>"
    return found.join(by_row, "row", "left").select(
        "doc_id",
        "base",
        F.coalesce("added", F.array().cast(NO_SPANS)).alias("added"),
        F.coalesce("told", F.array().cast(no_told)).alias("told"),
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
