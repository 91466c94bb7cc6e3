"""Silver: typed, blank-free staging tables, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.clean import blank_to_null, nan_to_null
from gaugeworks.operators.dedup import keep_any


def stage_activity(activity: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Keeps every measurement with an id; nothing is filtered for quality here.

    ``unique_ids=True`` also keeps one row per id (repeated pulls).
    """
    staged = activity.filter(F.col("activity_id").isNotNull()).select(
        "activity_id",
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "document_chembl_id",
        blank_to_null("standard_type").alias("standard_type"),
        # a blank relation is unknown, not '='
        blank_to_null("standard_relation").alias("standard_relation"),
        nan_to_null("standard_value").alias("standard_value"),
        blank_to_null("standard_units").alias("standard_units"),
        nan_to_null("standard_value_nm").alias("standard_value_nm"),
        blank_to_null("units_note").alias("units_note"),
        nan_to_null("pchembl_value").alias("pchembl_value"),
        blank_to_null("activity_comment").alias("activity_comment"),
        blank_to_null("data_validity_comment").alias("data_validity_comment"),
    )
    return keep_any(staged, ["activity_id"]) if unique_ids else staged


def _stage(
    df: DataFrame, key: str, texts: tuple[str, ...], doubles=(), ints=(), raw=()
) -> DataFrame:
    columns = {c: blank_to_null(c).alias(c) for c in texts}
    columns |= {c: F.col(c).try_cast("double").alias(c) for c in doubles}
    columns |= {c: F.col(c).try_cast("int").alias(c) for c in ints}
    columns |= {c: F.col(c) for c in (key, *raw)}
    order = [c for c in df.columns if c in columns]
    cleaned = df.filter(F.col(key).isNotNull()).select(*[columns[c] for c in order])
    return keep_any(cleaned, [key])


def stage_compound(molecule: DataFrame) -> DataFrame:
    return _stage(
        molecule,
        "molecule_chembl_id",
        ("pref_name", "canonical_smiles"),
        doubles=("molecular_weight", "alogp"),
        ints=("hba", "hbd", "ro5_violations"),
    )


def stage_target(target: DataFrame) -> DataFrame:
    return _stage(target, "target_chembl_id", ("target_name", "organism", "target_type"))


def stage_assay(assay: DataFrame) -> DataFrame:
    return _stage(
        assay,
        "assay_chembl_id",
        ("assay_type", "assay_description"),
        ints=("confidence_score",),
        raw=("target_chembl_id",),
    )


def stage_document(document: DataFrame) -> DataFrame:
    return _stage(document, "document_chembl_id", ("journal",), ints=("pubmed_id", "year"))
