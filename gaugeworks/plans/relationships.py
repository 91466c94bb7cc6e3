"""Relationship marts derived from the curated mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.dedup import keep_any
from gaugeworks.operators.graph import jaccard_similarity, member_group_edges, symmetrize

EDGE_KEYS = ("molecule_chembl_id", "compound_name", "target_chembl_id", "target_name")
MOST_PROMISCUOUS = 50


def compound_target_edges(curated: DataFrame) -> DataFrame:
    """Strongest evidence and row count per compound and target."""
    edges = member_group_edges(curated, EDGE_KEYS, "pchembl_value", "standard_value_nm")
    return edges.select(
        *EDGE_KEYS,
        F.col("max_pchembl_value").alias("best_pchembl"),
        F.col("min_standard_value_nm").alias("best_potency_nm"),
        "n_measurements",
    )


def target_similarity(curated: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Target pairs that share curated compounds, stored once with a < b.

    Ids alone travel through the pairing; names are joined to the finished pairs,
    from the target dimension when it is given, else from the curated rows.
    """
    pairs = jaccard_similarity(curated, "molecule_chembl_id", "target_chembl_id")
    names = keep_any(
        (curated if targets is None else targets).select("target_chembl_id", "target_name").distinct(),
        ["target_chembl_id"],
    )
    name_a = names.select(
        F.col("target_chembl_id").alias("group_a"), F.col("target_name").alias("target_a_name")
    )
    name_b = names.select(
        F.col("target_chembl_id").alias("group_b"), F.col("target_name").alias("target_b_name")
    )
    return (
        pairs.join(name_a, "group_a", "left")
        .join(name_b, "group_b", "left")
        .select(
            F.col("group_a").alias("target_a"),
            "target_a_name",
            F.col("group_b").alias("target_b"),
            "target_b_name",
            F.col("shared").alias("shared_compounds"),
            "jaccard",
        )
    )


def all_neighbors(similarity: DataFrame) -> DataFrame:
    """Both directions of every pair: the neighbours of every target."""
    both = symmetrize(
        similarity,
        ["target_a", "target_a_name"],
        ["target_b", "target_b_name"],
        ["shared_compounds", "jaccard"],
    )
    return both.select(
        F.col("source_0").alias("target_chembl_id"),
        F.col("neighbor_0").alias("neighbor_chembl_id"),
        F.col("neighbor_1").alias("neighbor_name"),
        "shared_compounds",
        "jaccard",
    )


def target_neighbors(similarity: DataFrame, target_id: str) -> DataFrame:
    """Targets most related to one target."""
    touching = (F.col("target_a") == target_id) | (F.col("target_b") == target_id)
    return (
        all_neighbors(similarity.filter(touching))
        .filter(F.col("target_chembl_id") == target_id)
        .drop("target_chembl_id")
        .orderBy(
            F.col("shared_compounds").desc(),
            F.col("jaccard").desc(),
            F.col("neighbor_chembl_id").asc(),
        )
    )


def compound_targets(edges: DataFrame, molecule_id: str) -> DataFrame:
    """The targets one compound is active against, strongest first."""
    return (
        edges.filter(F.col("molecule_chembl_id") == molecule_id)
        .select(
            "target_chembl_id", "target_name", "best_pchembl", "best_potency_nm", "n_measurements"
        )
        .orderBy(
            F.col("best_pchembl").desc_nulls_last(),
            F.col("best_potency_nm").asc_nulls_last(),
            F.col("target_chembl_id").asc(),
        )
    )


def most_promiscuous(edges: DataFrame, limit: int = MOST_PROMISCUOUS) -> DataFrame:
    """Compounds with edges to more than one target."""
    return (
        edges.groupBy("molecule_chembl_id", "compound_name")
        .agg(
            F.count(F.lit(1)).alias("targets_hit"),
            F.round(F.max("best_pchembl"), 2).alias("best_pchembl"),
        )
        .filter("targets_hit > 1")
        .orderBy(
            F.col("targets_hit").desc(),
            F.col("best_pchembl").desc_nulls_last(),
            F.col("molecule_chembl_id").asc(),
        )
        .limit(limit)
    )


def labelled_pairs(similarity: DataFrame) -> DataFrame:
    return similarity.select(
        F.concat(F.col("target_a_name"), F.lit(" <-> "), F.col("target_b_name")).alias("pair"),
        "shared_compounds",
        "jaccard",
    ).orderBy(F.col("shared_compounds").desc(), F.col("pair").asc())


def similarity_matrix(similarity: DataFrame) -> DataFrame:
    return similarity.select(
        "target_a_name", "target_b_name", "shared_compounds", "jaccard"
    ).orderBy(F.col("jaccard").desc(), "target_a_name", "target_b_name")


def ranked_targets(edges: DataFrame) -> DataFrame:
    """Batch form: the targets of every compound with their place, strongest first."""
    strongest = Window.partitionBy("molecule_chembl_id").orderBy(
        F.col("best_pchembl").desc_nulls_last(),
        F.col("best_potency_nm").asc_nulls_last(),
        F.col("target_chembl_id").asc(),
    )
    return edges.select(
        "molecule_chembl_id",
        "target_chembl_id",
        "best_pchembl",
        "best_potency_nm",
        "n_measurements",
        F.row_number().over(strongest).alias("place"),
    )
