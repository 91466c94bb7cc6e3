"""Relationship edges: bipartite member-group edges and group-group similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import materialize

# A member in at most this many groups is described by one array of its groups;
# members in more groups go through a blocked join. Both routes are exact.
LIGHT_DEGREE = 64
# Groups of one member that a task pairs with as many others of it at a time.
HEAVY_BLOCK = 1024


def member_group_edges(df: DataFrame, keys: Sequence[str], best: str, smallest: str) -> DataFrame:
    """One edge per key: largest ``best``, lowest ``smallest``, number of rows."""
    return df.groupBy(*keys).agg(
        F.max(best).alias(f"max_{best}"),
        F.min(smallest).alias(f"min_{smallest}"),
        F.count(F.lit(1)).alias("n_measurements"),
    )


def memberships(df: DataFrame, member: str, group: str) -> DataFrame:
    """Distinct (member, group) pairs without NULLs."""
    return (
        df.select(F.col(member).alias("member"), F.col(group).alias("grp"))
        .filter(F.col("member").isNotNull() & F.col("grp").isNotNull())
        .distinct()
    )


def group_sizes(pairs: DataFrame) -> DataFrame:
    """Members per group; the pairs are distinct, so a plain count is enough."""
    return pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"))


def shared_members(
    pairs: DataFrame, light_degree: int = LIGHT_DEGREE, heavy_block: int = HEAVY_BLOCK
) -> DataFrame:
    """(group_a, group_b, shared) for every two groups that share a member, a < b.

    Members that sit in exactly the same groups are merged first and carried as
    a count, so their pairs are formed once, not once per member. Pairs are
    summed on the map side and only (a, b) partial counts are shuffled. The groups
    of a member with many are cut into blocks of about ``heavy_block``, as many as its
    degree asks for, and every pair of blocks is joined on its own.
    """
    # Degrees are summed before they are shuffled: no task holds the groups of a member with many.
    degrees = pairs.groupBy("member").agg(F.count(F.lit(1)).alias("degree"))
    many = degrees.filter(F.col("degree") > light_degree)

    patterns = (
        pairs.join(many, "member", "left_anti")
        .groupBy("member")
        .agg(F.array_sort(F.collect_list("grp")).alias("groups"))
        .filter(F.size("groups") > 1)
        .groupBy("groups")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    light = (
        patterns.select("groups", "n", F.posexplode("groups").alias("at", "group_a"))
        .select(
            "group_a",
            F.explode(F.expr("slice(groups, at + 2, size(groups))")).alias("group_b"),
            "n",
        )
    )

    blocks = F.ceil(F.col("degree") / heavy_block).cast("int")
    heavy = (
        pairs.join(many, "member")
        .withColumn("own", F.pmod(F.xxhash64("grp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    left = heavy.select(
        "member", F.col("grp").alias("group_a"), F.col("own").alias("block_a"), F.col("other").alias("block_b")
    )
    right = heavy.select(
        "member", F.col("grp").alias("group_b"), F.col("other").alias("block_a"), F.col("own").alias("block_b")
    )
    spread = (
        left.join(right, ["member", "block_a", "block_b"])
        .filter(F.col("group_a") < F.col("group_b"))
        .select("group_a", "group_b", F.lit(1).cast("long").alias("n"))
    )

    return (
        light.unionByName(spread)
        .groupBy("group_a", "group_b")
        .agg(F.sum("n").alias("shared"))
    )


def jaccard_similarity(df: DataFrame, member: str, group: str, digits: int = 4) -> DataFrame:
    """Undirected group pairs with shared member count and Jaccard coefficient."""
    pairs = memberships(df, member, group)
    sizes = group_sizes(pairs)
    size_a = sizes.select(F.col("grp").alias("group_a"), F.col("n_members").alias("size_a"))
    size_b = sizes.select(F.col("grp").alias("group_b"), F.col("n_members").alias("size_b"))
    union_size = F.col("size_a") + F.col("size_b") - F.col("shared")
    return (
        shared_members(pairs)
        .join(size_a, "group_a")
        .join(size_b, "group_b")
        .select(
            "group_a",
            "group_b",
            "shared",
            F.round(F.col("shared") / union_size, digits).alias("jaccard"),
        )
    )


def similar_groups(
    df: DataFrame,
    member: str,
    group: str,
    least: float,
    bands: int = 48,
    rows: int = 2,
    digits: int = 4,
) -> DataFrame:
    """Group pairs with a Jaccard coefficient of ``least`` or more, found by set sketches.

    For graphs in which a member's pairs of groups cannot be written. A group's sketch is the
    least hash of its members under ``bands * rows`` hash functions; two groups are compared
    when all hashes of some band agree, which happens to a pair of coefficient j with
    probability 1 - (1 - j ** rows) ** bands. What is compared is counted exactly, from the
    members of the smaller group, so every returned coefficient is exact.
    """
    if not 0 < least <= 1 or bands < 1 or rows < 1:
        raise ValueError("least lies in (0, 1]; bands and rows are 1 or more")
    pairs = materialize(memberships(df, member, group))
    lowest = [F.min(F.xxhash64(F.lit(i), F.col("member"))) for i in range(bands * rows)]
    sketch = materialize(pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"), F.array(*lowest).alias("lowest")))

    keys = [F.xxhash64(F.lit(b), F.slice("lowest", b * rows + 1, rows)) for b in range(bands)]
    banded = sketch.select("grp", "n_members", F.explode(F.array(*keys)).alias("key"))
    left = banded.select("key", F.col("grp").alias("group_a"), F.col("n_members").alias("size_a"))
    right = banded.select("key", F.col("grp").alias("group_b"), F.col("n_members").alias("size_b"))
    # Sizes that differ too much rule the coefficient out.
    sized = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least
    met = (
        left.join(right, "key")
        .filter((F.col("group_a") < F.col("group_b")) & sized)
        .select("group_a", "group_b", "size_a", "size_b")
        .distinct()
    )

    first = F.col("size_a") <= F.col("size_b")
    asked = met.withColumn("grp", F.when(first, F.col("group_a")).otherwise(F.col("group_b"))).withColumn(
        "other", F.when(first, F.col("group_b")).otherwise(F.col("group_a"))
    )
    held = pairs.select(F.col("grp").alias("other"), "member")
    shared = (
        asked.join(pairs, "grp")
        .join(held, ["other", "member"])
        .groupBy("group_a", "group_b", "size_a", "size_b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    coefficient = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return shared.filter(coefficient >= least).select(
        "group_a", "group_b", "shared", F.round(coefficient, digits).alias("jaccard")
    )


def symmetrize(edges: DataFrame, a: Sequence[str], b: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Every undirected edge once per direction: ``source*`` columns, ``neighbor*`` columns."""
    names = [f"source_{i}" for i in range(len(a))], [f"neighbor_{i}" for i in range(len(b))]

    def side(here: Sequence[str], there: Sequence[str]) -> Column:
        return F.struct(
            *[F.col(c).alias(n) for c, n in zip(here, names[0])],
            *[F.col(c).alias(n) for c, n in zip(there, names[1])],
        )

    both = F.explode(F.array(side(a, b), side(b, a))).alias("edge")
    return edges.select(both, *rest).select("edge.*", *rest)
