"""The check suite of the warehouse: which checks run on which table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.rules import CURATED_TYPES, MIN_CONFIDENCE, RuleSet, potency_rules
from gaugeworks.operators.checks import (
    WARN,
    RowCheck,
    accepted_range,
    accepted_values,
    no_repeats,
    not_null,
    reconciles,
    relationships,
    run_suite,
    unique,
)
from gaugeworks.plans.gold import REPLICATE_KEYS

# The signs a measured value may carry.
RELATIONS = ("=", ">", "<", ">=", "<=", "~")

KEYS = {
    "stg_activity": ["activity_id"],
    "stg_compound": ["molecule_chembl_id"],
    "stg_target": ["target_chembl_id"],
    "stg_assay": ["assay_chembl_id"],
    "stg_document": ["document_chembl_id"],
    "dim_compound": ["compound_key", "molecule_chembl_id"],
    "dim_target": ["target_key", "target_chembl_id"],
    "dim_assay": ["assay_key", "assay_chembl_id"],
    "dim_document": ["document_key", "document_chembl_id"],
    "fact_bioactivity_result": ["activity_id"],
    "mart_compound_target_potency": ["activity_id"],
    "mart_target_activity_summary": ["target_chembl_id"],
    "mart_compound_profile": ["molecule_chembl_id"],
}


def curated_contract(
    types=CURATED_TYPES, min_confidence: int = MIN_CONFIDENCE
) -> RowCheck:
    """Independent re-check of the curated rows, with a positive value on top of the contract."""
    sign = F.col("standard_relation")
    bad = (
        ~F.col("standard_type").isin(list(types))
        | F.col("standard_value_nm").isNull()
        | (F.col("standard_value_nm") <= 0)
        | F.col("pchembl_value").isNull()
        | (F.col("confidence_score") < min_confidence)
        | (sign.isNotNull() & (sign != "="))
    )
    return RowCheck("curated_is_comparable", bad)


def warehouse_suite(
    tables: Mapping[str, DataFrame],
    rules: RuleSet | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    one_by_one: bool = False,
) -> DataFrame:
    """Run every check whose table is given; ``parents`` are looked up by foreign keys and not checked."""
    rules = rules or potency_rules()
    parents = {**(parents or {}), **tables}
    suite = []
    for name, df in tables.items():
        row_checks = [not_null(k) for k in KEYS.get(name, [])]
        table_checks = [unique(df, k) for k in KEYS.get(name, [])]
        if name == "bronze_activity":
            row_checks.append(not_null("activity_id"))
        elif name == "stg_activity":
            row_checks.append(accepted_values("standard_relation", RELATIONS, severity=WARN))
        elif name == "dim_assay":
            row_checks.append(accepted_range("confidence_score", 0, 9, severity=WARN))
        elif name == "fact_bioactivity_result":
            table_checks.append(reconciles(df, rules.reason()))
            for key, parent in (("target_key", "dim_target"), ("compound_key", "dim_compound")):
                if parent in parents:
                    table_checks.append(relationships(df, key, parents[parent], key))
        elif name == "mart_compound_target_potency":
            row_checks += [
                not_null("standard_value_nm"),
                not_null("pchembl_value"),
                accepted_values("standard_type", rules.types),
                accepted_range("confidence_score", rules.min_confidence, 9),
                accepted_values("standard_relation", ["="], F.col("standard_relation").isNotNull()),
                curated_contract(rules.types, rules.min_confidence),
            ]
            table_checks.append(no_repeats(df, REPLICATE_KEYS, "no_duplicate_measurements"))
        elif name == "mart_assay_quality":
            row_checks.append(not_null("assay_chembl_id"))
            table_checks.append(
                no_repeats(df, ["assay_chembl_id", "target_chembl_id"], "unique_assay_and_target")
            )
        elif name == "mart_data_quality_summary":
            row_checks.append(not_null("value"))
        suite.append((name, df, row_checks, table_checks))
    return run_suite(suite, one_by_one)
