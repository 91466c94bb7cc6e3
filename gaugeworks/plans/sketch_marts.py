"""Target and compound marts from stored batches of mergeable states.

The exact marts read every measurement; these read one small row per group and batch.
Replicates are chosen inside a batch, so batches that hold whole assays (or documents) have
the curated rows of the exact mart, while a replicate that is spread over two batches counts
in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.sketches import Summary, read_estimates, write_batch
from gaugeworks.plans.gold import Curation, curated_rows

TARGET, COMPOUND = ("target_chembl_id",), ("molecule_chembl_id",)

# Output columns of the exact marts.
TARGET_COVERAGE = Summary(
    TARGET,
    "total_measurements",
    distinct={"total_compounds_tested": "molecule_chembl_id", "total_assays": "assay_chembl_id"},
)
TARGET_POTENCY = Summary(
    TARGET,
    "curated_measurements",
    largest={"best_pchembl": "pchembl_value"},
    distinct={"active_compounds": "molecule_chembl_id"},
    quantiles={"median_potency_nm": "standard_value_nm", "median_pchembl": "pchembl_value"},
)
COMPOUND_COVERAGE = Summary(
    COMPOUND,
    "total_measurements",
    distinct={"targets_tested": "target_chembl_id", "assays_tested": "assay_chembl_id"},
)
COMPOUND_POTENCY = Summary(
    COMPOUND,
    "curated_measurements",
    largest={"best_pchembl": "pchembl_value"},
    least={"best_potency_nm": "standard_value_nm"},
    distinct={"curated_targets": "target_chembl_id"},
)
SIDES = {"target": (TARGET_COVERAGE, TARGET_POTENCY), "compound": (COMPOUND_COVERAGE, COMPOUND_POTENCY)}


def add_batch(
    facts: DataFrame, path: str, batch: str, curated: DataFrame | None = None, curation: Curation | None = None
) -> None:
    """Store what both marts need of one batch of measurements.

    ``curated`` are the batch's curated rows, when they are known already.
    """
    if curated is None:
        curated = curated_rows(facts, curation)
    for grain, (coverage, potency) in SIDES.items():
        write_batch(facts, coverage, f"{path}/{grain}/coverage", batch)
        write_batch(curated, potency, f"{path}/{grain}/potency", batch)


def _joined(spark: SparkSession, grain: str, path: str, dimension: DataFrame) -> DataFrame:
    """A dimension with the estimates of both sides; members that were never measured have zeros."""
    out = dimension
    for summary, side in zip(SIDES[grain], ("coverage", "potency"), strict=True):
        numbers = read_estimates(spark, summary, f"{path}/{grain}/{side}")
        counted = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (summary.rows, *summary.distinct)}
        out = out.join(numbers, list(summary.keys), "left").withColumns(counted)
    return out


def target_summary_merged(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """The columns of ``target_activity_summary``, from all stored batches."""
    return _joined(spark, "target", path, targets.select("target_chembl_id", "target_name", "organism"))


def compound_profile_merged(spark: SparkSession, path: str, compounds: DataFrame) -> DataFrame:
    """The counts and best values of ``compound_profile``, from all stored batches."""
    return _joined(spark, "compound", path, compounds.select("molecule_chembl_id", "pref_name"))
