"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by a hash of their id. A source whose target
is r times its size takes floor(r) whole passes over its blocks and, in one more pass,
blocks in permuted order up to the rest; the block that crosses the rest gives documents
in permuted order while they fit, and then the one whose size is nearest to what is still
missing. Every (pass, block) is one unit of the source's quota.

The quotas are split exactly among the output shards: the root holds all quotas; a node
hands its left half as many units as its shards hold, drawn without replacement from the
node's units of all sources (one hypergeometric draw per source, by inversion of the
exact distribution), and the right half gets the rest. Each leaf then draws disjoint runs
of every source's permuted units, and rows are put in a permuted order inside their shard.

All draws are hashes of a seed, so reruns agree. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import WORD
from gaugeworks.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
SHARD_WORDS = 4_000_000
BLOCK_DOCS = 64
# Most blocks of one source; a larger source has larger blocks. Bounds every window over blocks.
MAX_BLOCKS = 4096
# Draws up to this many rows (24 bytes each) are broadcast to the documents; more are joined.
BROADCAST_DRAWS = 500_000


@dataclass(frozen=True)
class Mix:
    """sizes: doc_id, source, size. plan: one row per source. draws: s, block, cut, extra, pass, shard, rank."""

    sizes: DataFrame
    plan: DataFrame
    draws: DataFrame
    shards: int
    seed: int


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: s (its rank), source, docs, source_size, target.

    Sources in code point order, NULL last, take the weights in turn and share the sum of
    all sizes; a target stops at ``max_repeats`` times the source's size and the excess is
    shared again by weight. In order of the size a source can give per unit of weight, the
    first source that needs no cap gives the level at which all later ones are filled.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")
    )
    ranked = (
        per_source.withColumn("s", F.row_number().over(in_order) - 1)
        .withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(max_repeats))
        .withColumn("gives", F.col("cap") / F.col("weight"))
    )
    by_gift = Window.orderBy("gives", "s")
    before = by_gift.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_gift.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    leveled = ranked.withColumn("level", level)
    fill = F.min(F.when(F.col("level") <= F.col("gives"), F.struct("gives", "s", "level"))).over(everything)["level"]
    return leveled.withColumn("fill", fill).select(
        F.col("s").cast("int").alias("s"),
        "source",
        "docs",
        "source_size",
        F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` of ``total`` units are among the ``good`` ones, by inversion.

    Weights follow from one another by the ratio of neighbours. They are summed over the
    support, or over twelve deviations around the mean, beyond which a double holds nothing.
    """
    mean = drawn * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1)))) * 12 + 20
    low = F.greatest(F.lit(0), drawn - (total - good), F.floor(mean - spread)).cast("long")
    high = F.least(drawn, good, F.ceil(mean + spread)).cast("long")

    def following(v: Column, weight: Column, k: Column) -> Column:
        up = (v["good"] - k).cast("double") * (v["drawn"] - k)
        down = (k + 1).cast("double") * (v["total"] - v["good"] - v["drawn"] + k + 1)
        return weight * up / down

    def mass(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        step = lambda a, k: F.struct(following(v, a["w"], k).alias("w"), (a["t"] + a["w"]).alias("t"))
        return F.aggregate(F.sequence(v["low"], v["high"]), start, step, lambda a: a["t"])

    def pick(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), F.lit(-1).cast("long").alias("x"))

        def step(a: Column, k: Column) -> Column:
            reached = (a["x"] < 0) & (a["t"] + a["w"] >= v["goal"])
            return F.struct(
                following(v, a["w"], k).alias("w"), (a["t"] + a["w"]).alias("t"), F.when(reached, k).otherwise(a["x"]).alias("x")
            )

        return F.aggregate(
            F.sequence(v["low"], v["high"]), start, step, lambda a: F.when(a["x"] < 0, v["high"]).otherwise(a["x"])
        )

    names = {"total": total, "good": good, "drawn": drawn, "low": low, "high": high}
    bound = F.struct(*[c.cast("long").alias(n) for n, c in names.items()], uniform.alias("u"))
    weighed = F.transform(F.array(bound), lambda v: F.struct(*[v[n].alias(n) for n in names], (v["u"] * mass(v)).alias("goal")))
    return F.element_at(F.transform(weighed, pick), 1)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (s, shard, quota) that add up to the quotas (s, quota) exactly.

    The nodes of one level are the rows of one table: lo, hi (shards), quotas (by source).
    """
    everything = F.array_sort(F.collect_list(F.struct("s", "quota")))
    nodes = quotas.agg(everything.alias("all")).select(
        F.lit(0).alias("lo"),
        F.lit(shards).alias("hi"),
        F.col("all.quota").alias("quotas"),
        F.aggregate("all.quota", F.lit(0).cast("long"), lambda a, q: a + q).alias("units"),
    )
    first = lambda shard: F.floor(F.col("units") * shard / F.lit(shards)).cast("long")
    width = 1
    while width < shards:
        node = nodes.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
        start = F.struct(
            F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q).alias("total"),
            (first(F.col("mid")) - first(F.col("lo"))).alias("drawn"),
            F.array().cast("array<bigint>").alias("got"),
        )

        def draw(a: Column, good: Column) -> Column:
            uniform = _uniform(F.lit(seed), F.lit("split"), F.col("lo"), F.col("hi"), F.size(a["got"]))
            return F.element_at(
                F.transform(
                    F.array(hypergeometric(a["total"], good, a["drawn"], uniform)),
                    lambda x: F.struct(
                        (a["total"] - good).alias("total"),
                        (a["drawn"] - x).alias("drawn"),
                        F.concat(a["got"], F.array(x)).alias("got"),
                    ),
                ),
                1,
            )

        halved = node.withColumn("left", F.aggregate("quotas", start, draw, lambda a: a["got"]))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        half = lambda lo, hi, q: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), q.alias("quotas"), F.col("units"))
        one = F.array(half("lo", "hi", F.col("quotas")))
        two = F.array(half("lo", "mid", F.col("left")), half("mid", "hi", rest))
        split = F.when(F.col("hi") - F.col("lo") > 1, two).otherwise(one)
        nodes = materialize(halved.select(F.inline(split)))
        width *= 2
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("quotas").alias("s", "quota"))
    return leaves.filter("quota > 0")


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    shard_words: int = SHARD_WORDS,
    seed: int = 11,
) -> Mix:
    """Which units each shard draws. Texts are read once, for their sizes.

    NULL texts have size 0; NULL is a source of its own, the last; rows of one id are
    taken or left together; an empty table gives empty results.
    """
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")))
    per_source = materialize(targets(sizes, weights, max_repeats))
    total = per_source.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, round(total / shard_words))

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = per_source.withColumn("passes", passes.cast("int")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    plan = materialize(plan.withColumn("blocks", F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("int")))
    dealt = _dealt(sizes, plan, "doc_id", seed)

    blocks = dealt.groupBy("s", "block").agg(F.sum("size").alias("size"))
    shuffled = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), F.col("block")), "block")
    upto = F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = blocks.withColumn("upto", upto).join(plan.select("s", "passes", "rest"), "s")
    laid = materialize(laid)
    whole = laid.filter("upto <= rest").select("s", "block")
    crossing = laid.filter("upto > rest and upto - size <= rest").select(
        "s", "block", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("left")
    )
    inside = Window.partitionBy("s").orderBy("h")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    crossed = (
        dealt.join(crossing, ["s", "block"])
        .groupBy("s", "block", "left", "h")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", upto)
    )
    crossed = materialize(crossed)
    fits = F.col("upto") <= F.col("left")
    cut = crossed.groupBy("s", "block", "left").agg(
        F.max(F.when(fits, F.col("h"))).alias("cut"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("had")
    )
    over = crossed.filter(~fits).join(cut.select("s", "had"), "s")
    gap = F.col("left") - F.col("had")
    miss = F.abs(F.col("size") - gap)
    extra = over.filter(miss < gap).groupBy("s").agg(F.min(F.struct(miss.alias("miss"), "h"))["h"].alias("extra"))
    lowest = F.lit(-(2**63)).cast("long")
    # Hashes up to cut are in, and the one called extra; the lowest long stands for none.
    cut = cut.join(extra, "s", "left").select("s", "block", F.coalesce("cut", lowest).alias("cut"), "extra")

    no_cut = [F.lit(None).cast("long").alias(c) for c in ("cut", "extra")]
    rounds = F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass")
    units = (
        laid.filter("passes > 0").select("s", "block", *no_cut, rounds)
        .unionByName(whole.select("s", "block", *no_cut, F.lit(0).alias("pass")))
        .unionByName(cut.select("s", "block", "cut", "extra", F.lit(0).alias("pass")))
    )
    order = F.xxhash64(F.lit(seed), F.lit("unit"), F.col("pass"), F.col("block"))
    ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(order, "pass", "block")))
    ranked = materialize(ranked)

    quotas = ranked.groupBy("s").agg(F.count("*").alias("quota"))
    split = split_quotas(quotas, shards, seed)
    upto_shard = F.sum("quota").over(Window.partitionBy("s").orderBy("shard"))
    runs = split.withColumn("last", upto_shard).select(
        "s", "shard", F.explode(F.sequence(F.col("last") - F.col("quota") + 1, F.col("last"))).alias("rank")
    )
    draws = materialize(ranked.withColumn("rank", F.col("rank").cast("long")).join(runs, ["s", "rank"]))
    return Mix(sizes, plan, draws, shards, seed)


def _dealt(rows: DataFrame, plan: DataFrame, doc_id: str, seed: int) -> DataFrame:
    """Adds s, block and h (the order inside a block) to rows with ``source`` and an id."""
    small = plan.select("s", F.col("source").alias("_source"), "blocks")
    joined = rows.join(small, rows["source"].eqNullSafe(small["_source"])).drop("_source")
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col(doc_id)), F.col("blocks")).cast("int")
    h = F.xxhash64(F.lit(seed), F.lit("doc"), F.col(doc_id))
    return joined.withColumn("block", block).withColumn("h", h).drop("blocks")


def _inside() -> Column:
    """Is a row of a cut block taken?"""
    return (F.col("h") <= F.col("cut")) | F.coalesce(F.col("h") == F.col("extra"), F.lit(False))


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (repeats counted)."""
    drawn = mix.draws.groupBy("s", "block").agg(
        F.sum(F.when(F.col("cut").isNull(), 1).otherwise(0)).alias("times"),
        F.max("cut").alias("cut"),
        F.max("extra").alias("extra"),
    )
    dealt = _dealt(mix.sizes, mix.plan, "doc_id", mix.seed)
    facts = mix.plan.select("s", "source_size", "target")
    times = F.coalesce("times", F.lit(0)) + F.when(_inside(), 1).otherwise(0)
    return (
        dealt.join(drawn, ["s", "block"], "left")
        .join(facts, "s")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: documents with all their columns, repeated as drawn, shard by shard in a permuted order.

    Each shard is one partition, placed by its number.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    dealt = _dealt(rows, mix.plan, "doc_id", mix.seed)
    draws = mix.draws.select("s", "block", "cut", "extra", "pass", "shard")
    if draws.count() <= BROADCAST_DRAWS:
        draws = F.broadcast(draws)
    drawn = dealt.join(draws, ["s", "block"]).filter(F.col("cut").isNull() | _inside())
    place = F.xxhash64(F.lit(mix.seed), F.lit("place"), F.col("pass"), F.col("h"))
    return (
        drawn.withColumn("place", place)
        .repartitionById(mix.shards, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "place", "doc_id", "pass")
        .select("row.*")
    )
