"""Read operators over the marts: profiles, summaries, explanations, dashboard queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.rules import INCLUDED, RuleSet, potency_rules
from gaugeworks.operators.dedup import top_per_group

# Result sizes.
PROFILE_EVIDENCE = 50
EXPLAINED_ROWS = 100

EVIDENCE_DOCUMENT = (
    "activity_id",
    "molecule_chembl_id",
    "compound_name",
    "canonical_smiles",
    "target_chembl_id",
    "target_name",
    "assay_chembl_id",
    "assay_description",
    "standard_type",
    "standard_value_nm",
    "pchembl_value",
    "confidence_score",
    "journal",
    "year",
)


def evidence_documents(curated: DataFrame) -> DataFrame:
    """The searchable documents, one per curated row; the document id is the activity id."""
    return curated.select(F.col("activity_id").cast("string").alias("doc_id"), *EVIDENCE_DOCUMENT)


def optionally(df: DataFrame, column: str, value) -> DataFrame:
    """``column = value`` when a value is given, else everything."""
    return df if value is None else df.filter(F.col(column) == value)


def at_least(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) >= value)


def strongest(*ties: str) -> list[Column]:
    return [F.col("pchembl_value").desc_nulls_last(), *[F.col(t).asc() for t in ties]]


# ---------------------------------------------------------------- one compound


def profile_evidence(curated: DataFrame, molecule_id: str, limit: int = PROFILE_EVIDENCE) -> DataFrame:
    return (
        curated.filter(F.col("molecule_chembl_id") == molecule_id)
        .orderBy(*strongest("activity_id"))
        .limit(limit)
        .select(
            "target_chembl_id",
            "target_name",
            "assay_chembl_id",
            "assay_description",
            "standard_type",
            "standard_value_nm",
            "pchembl_value",
            "confidence_score",
            "journal",
            "year",
        )
    )


def best_by_target(curated: DataFrame, molecule_id: str | None = None) -> DataFrame:
    """Best potency per compound and target, for one compound or for all."""
    return (
        optionally(curated, "molecule_chembl_id", molecule_id)
        .groupBy("molecule_chembl_id", "target_chembl_id", "target_name")
        .agg(
            F.max("pchembl_value").alias("best_pchembl"),
            F.min("standard_value_nm").alias("best_potency_nm"),
        )
    )


def compound_report(profile: DataFrame, curated: DataFrame, molecule_id: str) -> dict[str, DataFrame]:
    """Profile row, best potency per target, strongest evidence of one compound."""
    wanted = molecule_id.strip().upper()
    return {
        "profile": profile.filter(F.col("molecule_chembl_id") == wanted),
        "best_potency_by_target": best_by_target(curated, wanted).orderBy(
            F.col("best_pchembl").desc_nulls_last(), "target_chembl_id"
        ),
        "assay_evidence": profile_evidence(curated, wanted),
    }


def strongest_evidence(curated: DataFrame, per_compound: int = PROFILE_EVIDENCE) -> DataFrame:
    """Batch form: the strongest rows of every compound, ranked."""
    return top_per_group(
        curated, ["molecule_chembl_id"], strongest("activity_id"), per_compound
    )


def nested_profiles(
    profile: DataFrame, curated: DataFrame, per_compound: int = PROFILE_EVIDENCE
) -> DataFrame:
    """One row per compound with its evidence and its best targets as arrays.

    The evidence array holds at most ``per_compound`` rows; the target array one
    entry per target. Both are cut or reduced before they are gathered.
    """
    key = "molecule_chembl_id"
    evidence = (
        strongest_evidence(curated, per_compound)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank", "target_chembl_id", "assay_chembl_id", "standard_type", "pchembl_value"
                    )
                )
            ).alias("assay_evidence")
        )
    )
    targets = (
        best_by_target(curated)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("target_chembl_id", "best_pchembl", "best_potency_nm"))
            ).alias("best_potency_by_target")
        )
    )
    return profile.join(evidence, key, "left").join(targets, key, "left")


# ------------------------------------------------------------------ one target


def breakdown_by_type(curated: DataFrame, target_id: str | None = None) -> DataFrame:
    """Curated rows per type; the missing count is 0 by construction of the mart."""
    return (
        optionally(curated, "target_chembl_id", target_id)
        .groupBy("target_chembl_id", "standard_type")
        .agg(
            F.count_if(F.col("pchembl_value").isNull()).alias("missing_pchembl"),
            F.count(F.lit(1)).alias("curated_rows"),
        )
    )


def target_report(summary: DataFrame, curated: DataFrame, target_id: str) -> dict[str, DataFrame]:
    return {
        "summary": summary.filter(F.col("target_chembl_id") == target_id),
        "curated_breakdown_by_type": breakdown_by_type(curated, target_id).orderBy(
            F.col("curated_rows").desc(), "standard_type"
        ),
    }


# ----------------------------------------------------------------- explanation


def explain_rows(
    facts: DataFrame,
    column: str,
    value,
    rules: RuleSet | None = None,
    limit: int | None = EXPLAINED_ROWS,
    unknown_passes: Sequence[str] = (),
) -> DataFrame:
    """Fact rows of one id, compound or assay with their outcome: the first ``limit`` in id order, or all."""
    outcome = (rules or potency_rules()).reason(unknown_passes)
    rows = (
        facts.filter(F.col(column) == value)
        .select(
            "activity_id",
            "molecule_chembl_id",
            "target_chembl_id",
            "assay_chembl_id",
            "standard_type",
            "standard_relation",
            "standard_value_nm",
            "pchembl_value",
            "confidence_score",
            "data_validity_comment",
            outcome.alias("curation_outcome"),
        )
    )
    return rows if limit is None else rows.orderBy("activity_id").limit(limit)


def outcome_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(F.col("curation_outcome") == INCLUDED).alias("included"),
        F.count_if(F.col("curation_outcome") != INCLUDED).alias("excluded"),
    ]


def explained_totals(rows: DataFrame) -> DataFrame:
    """Included and excluded among the rows given; ``explain_rows(limit=None)`` gives all."""
    return rows.agg(*outcome_counts())


def excluded_by_reason(quality: DataFrame) -> DataFrame:
    return (
        quality.filter(F.col("metric_group") == "excluded_by_reason")
        .select(F.col("metric").alias("reason"), "value")
        .orderBy(F.col("value").desc(), "reason")
    )


# ------------------------------------------------------------ dashboard queries


def kpi(quality: DataFrame, metric: str) -> DataFrame:
    return quality.filter(F.col("metric") == metric).select("value")


def kpi_board(quality: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """All wanted metrics side by side in one row, from one read of the summary."""
    return quality.groupBy().pivot("metric", list(metrics)).agg(F.first("value"))


def bars(summary: DataFrame, measure: str, target_id: str | None = None, descending: bool = True) -> DataFrame:
    order = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    return (
        optionally(summary, "target_chembl_id", target_id)
        .select("target_name", measure)
        .orderBy(order, "target_name")
    )


def evidence_table(
    curated: DataFrame,
    target_id: str | None = None,
    molecule_id: str | None = None,
    standard_type: str | None = None,
    min_pchembl: float | None = None,
    min_confidence: int | None = None,
) -> DataFrame:
    rows = optionally(curated, "target_chembl_id", target_id)
    rows = optionally(rows, "molecule_chembl_id", molecule_id)
    rows = optionally(rows, "standard_type", standard_type)
    rows = at_least(rows, "pchembl_value", min_pchembl)
    rows = at_least(rows, "confidence_score", min_confidence)
    return rows.orderBy(*strongest("activity_id")).select(
        "activity_id",
        "compound_name",
        "target_name",
        "standard_type",
        "standard_value_nm",
        "pchembl_value",
        "confidence_score",
        "assay_description",
        "journal",
        "year",
    )


def best_pchembl_by_target(curated: DataFrame, molecule_id: str | None = None) -> DataFrame:
    return (
        optionally(curated, "molecule_chembl_id", molecule_id)
        .groupBy("target_name")
        .agg(F.max("pchembl_value").alias("best_pchembl"))
        .orderBy(F.col("best_pchembl").desc_nulls_last(), "target_name")
    )


def publication_lineage(curated: DataFrame, molecule_id: str | None = None) -> DataFrame:
    return (
        optionally(curated, "molecule_chembl_id", molecule_id)
        .select("journal", "year", "document_chembl_id")
        .distinct()
        .orderBy(F.col("year").desc_nulls_last(), "document_chembl_id")
    )


def assay_detail(quality: DataFrame, target_id: str | None = None) -> DataFrame:
    return (
        optionally(quality, "target_chembl_id", target_id)
        .select(
            "assay_chembl_id",
            "target_name",
            "confidence_score",
            "total_measurements",
            "curated_measurements",
            "missing_pchembl",
            "ambiguous_relation",
        )
        .orderBy(F.col("confidence_score").asc_nulls_last(), "assay_chembl_id", "target_name")
    )


def compound_properties(profile: DataFrame, molecule_id: str | None = None) -> DataFrame:
    return optionally(profile, "molecule_chembl_id", molecule_id).select(
        "molecule_chembl_id",
        "compound_name",
        "molecular_weight",
        "alogp",
        "hba",
        "hbd",
        "ro5_violations",
        "canonical_smiles",
    )


def rounded_medians(summary: DataFrame, digits: int = 2) -> DataFrame:
    return summary.select(
        "target_name",
        "curated_measurements",
        F.round("median_potency_nm", digits).alias("median_potency_nm"),
        F.round("median_pchembl", digits).alias("median_pchembl"),
    ).orderBy(F.col("curated_measurements").desc(), "target_name")


def top_compounds(curated: DataFrame, k: int = 10) -> DataFrame:
    """The most potent curated rows of every target."""
    return top_per_group(curated, ["target_chembl_id"], strongest("activity_id"), k)


def curated_counts(curated: DataFrame) -> DataFrame:
    return (
        curated.groupBy("target_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "target_name")
    )


def top_assays(quality: DataFrame, k: int = 5) -> DataFrame:
    """The assays of every target with most curated rows."""
    order = [F.col("curated_measurements").desc(), F.col("assay_chembl_id").asc()]
    return top_per_group(quality, ["target_chembl_id"], order, k)


def compare_targets(summary: DataFrame, targets: Sequence[str]) -> DataFrame:
    return (
        summary.filter(F.col("target_chembl_id").isin(list(targets)))
        .select(
            "target_chembl_id",
            "target_name",
            "total_assays",
            "active_compounds",
            "curated_measurements",
        )
        .orderBy("target_chembl_id")
    )


# ------------------------------------------------------------- semantic models

# Model name -> mart.
MODELS = {
    "Curated Potency Evidence": "mart_compound_target_potency",
    "Target Activity Summary": "mart_target_activity_summary",
    "Assay Quality": "mart_assay_quality",
    "Compound Profile": "mart_compound_profile",
    "Data Quality Summary": "mart_data_quality_summary",
    "Target Similarity": "graph_target_similarity",
    "Compound-Target Edges": "graph_compound_target_edge",
}


def register_models(marts: Mapping[str, DataFrame]) -> list[str]:
    """Every model as a temp view under its display name."""
    for name, mart in MODELS.items():
        marts[mart].createOrReplaceTempView(f"`{name}`")
    return list(MODELS)
