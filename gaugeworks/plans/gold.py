"""Gold: dimensions, the measurement fact, the curated mart and its summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.rules import RuleSet, potency_rules
from gaugeworks.operators.dedup import distinct_counts, keep_first
from gaugeworks.operators.quality import (
    completeness_metrics,
    exclusion_metrics,
    issue_metrics,
    long_metrics,
    surplus_rows,
    volume_metrics,
)
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.operators.star import Dimension, attach_attributes, attach_keys, build_dimension

REPLICATE_KEYS = ("molecule_chembl_id", "target_chembl_id", "assay_chembl_id", "standard_type")


@dataclass(frozen=True)
class Curation:
    """The inclusion contract; its rule set also holds the low-confidence bound.

    Ids are counted distinct. ``unique_ids`` states that ``activity_id`` is known to be
    unique in the fact (the check suite tells); counting is then a plain count,
    which spares the largest of the distinct expansions. ``apart`` makes each count in a job of its own.
    """

    rules: RuleSet = field(default_factory=potency_rules)
    unique_ids: bool = False
    apart: bool = False

    @property
    def min_confidence(self) -> int:
        return self.rules.min_confidence

    def counts(self, df: DataFrame, key: str, ids: str, columns: Mapping[str, str]) -> DataFrame:
        """Per known key: the ids of ``df`` as ``ids`` and the distinct values of ``columns``."""
        if not self.unique_ids:
            return distinct_counts(df, key, {ids: "activity_id", **columns}, self.apart)
        plain = df.filter(F.col(key).isNotNull()).groupBy(key).agg(self.id_count().alias(ids))
        return plain.join(distinct_counts(df, key, columns, self.apart), key, "full")

    def id_count(self):
        return F.count("activity_id") if self.unique_ids else F.count_distinct("activity_id")


# ------------------------------------------------------------------ dimensions


def dim_compound(stg: DataFrame) -> DataFrame:
    return build_dimension(
        stg,
        "compound_key",
        "molecule_chembl_id",
        [
            "pref_name",
            "canonical_smiles",
            "molecular_weight",
            "alogp",
            "hba",
            "hbd",
            "ro5_violations",
        ],
    )


def dim_target(stg: DataFrame) -> DataFrame:
    return build_dimension(
        stg, "target_key", "target_chembl_id", ["target_name", "organism", "target_type"]
    )


def dim_assay(stg: DataFrame) -> DataFrame:
    return build_dimension(
        stg, "assay_key", "assay_chembl_id", ["assay_type", "assay_description", "confidence_score"]
    )


def dim_document(stg: DataFrame) -> DataFrame:
    return build_dimension(
        stg, "document_key", "document_chembl_id", ["pubmed_id", "journal", "year"]
    )


@dataclass(frozen=True)
class Dimensions:
    compound: DataFrame
    target: DataFrame
    assay: DataFrame
    document: DataFrame


# ------------------------------------------------------------------------ fact

# Columns of the fact, in order.
FACT_COLUMNS = (
    "activity_id",
    "compound_key",
    "target_key",
    "assay_key",
    "document_key",
    "molecule_chembl_id",
    "target_chembl_id",
    "assay_chembl_id",
    "document_chembl_id",
    "standard_type",
    "standard_relation",
    "standard_value",
    "standard_units",
    "standard_value_nm",
    "pchembl_value",
    "activity_comment",
    "data_validity_comment",
    "confidence_score",
    "units_note",
)


def attach(activity: DataFrame, dims: Dimensions, names: Sequence[str]) -> DataFrame:
    """The measurements with the keys of the named dimensions (and the assay's confidence)."""
    known = {
        "assay": Dimension(dims.assay, "assay_key", "assay_chembl_id", ("confidence_score",), hashed=True),
        "target": Dimension(dims.target, "target_key", "target_chembl_id", hashed=True),
        "compound": Dimension(dims.compound, "compound_key", "molecule_chembl_id", hashed=True),
        "document": Dimension(dims.document, "document_key", "document_chembl_id", hashed=True),
    }
    return attach_keys(activity, [known[n] for n in names])


def fact(activity: DataFrame, dims: Dimensions) -> DataFrame:
    """One row per measurement, good or bad, with dimension keys and the assay's confidence."""
    keyed = attach(activity, dims, ("assay", "target", "compound", "document"))
    return keyed.select(*FACT_COLUMNS)


# ---------------------------------------------------------------- curated mart

# Columns of the curated mart, in order.
CURATED_COLUMNS = (
    "activity_id",
    "molecule_chembl_id",
    "compound_name",
    "canonical_smiles",
    "molecular_weight",
    "alogp",
    "target_chembl_id",
    "target_name",
    "organism",
    "assay_chembl_id",
    "assay_type",
    "assay_description",
    "confidence_score",
    "standard_type",
    "standard_relation",
    "standard_value_nm",
    "pchembl_value",
    "document_chembl_id",
    "journal",
    "year",
)


def curated_rows(facts: DataFrame, curation: Curation | None = None) -> DataFrame:
    """Comparable fact rows, replicates collapsed to the strongest one."""
    curation = curation or Curation()
    order = [
        F.col("pchembl_value").desc_nulls_last(),
        F.col("standard_value_nm").asc_nulls_last(),
        F.col("activity_id").asc_nulls_last(),
    ]
    return keep_first(facts.filter(curation.rules.predicate()), REPLICATE_KEYS, order)


def curated_mart(
    facts: DataFrame, dims: Dimensions, curation: Curation | None = None
) -> DataFrame:
    """Curated rows with the attributes of all four dimensions."""
    compound = dims.compound.withColumnRenamed("pref_name", "compound_name")
    wide = attach_attributes(
        curated_rows(facts, curation),
        [
            Dimension(
                compound,
                "compound_key",
                "",
                ("compound_name", "canonical_smiles", "molecular_weight", "alogp"),
            ),
            Dimension(dims.target, "target_key", "", ("target_name", "organism")),
            Dimension(dims.assay, "assay_key", "", ("assay_type", "assay_description")),
            Dimension(dims.document, "document_key", "", ("journal", "year")),
        ],
    )
    return wide.select(*CURATED_COLUMNS)


def curated_from_activity(
    activity: DataFrame, dims: Dimensions, curation: Curation | None = None
) -> DataFrame:
    """The same rows as ``curated_mart`` over ``fact``, with one join a dimension.

    The contract needs the assay's confidence alone. Its texts come with it; the other three
    dimensions are joined on their natural ids, and only to the rows that were chosen.
    """
    assay = Dimension(
        dims.assay, "assay_key", "assay_chembl_id", ("confidence_score", "assay_type", "assay_description")
    )
    compound = dims.compound.withColumnRenamed("pref_name", "compound_name")
    attributes = ("compound_name", "canonical_smiles", "molecular_weight", "alogp")
    chosen = curated_rows(attach_keys(activity, [assay]), curation)
    wide = attach_keys(
        chosen,
        [
            Dimension(compound, "compound_key", "molecule_chembl_id", attributes),
            Dimension(dims.target, "target_key", "target_chembl_id", ("target_name", "organism")),
            Dimension(dims.document, "document_key", "document_chembl_id", ("journal", "year")),
        ],
    )
    return wide.select(*CURATED_COLUMNS)


# ------------------------------------------------------------------- summaries


def _zero(column: str):
    return F.coalesce(F.col(column), F.lit(0).cast("bigint")).alias(column)


def target_activity_summary(
    facts: DataFrame, curated: DataFrame, targets: DataFrame, curation: Curation | None = None
) -> DataFrame:
    """Coverage over all rows and quality over curated rows, per target.

    Each grain is aggregated to one row per target before the join; joined on
    target alone the two would multiply.
    """
    curation = curation or Curation()
    key = "target_chembl_id"
    coverage = curation.counts(
        facts,
        key,
        "total_measurements",
        {"total_compounds_tested": "molecule_chembl_id", "total_assays": "assay_chembl_id"},
    )
    counts = curation.counts(curated, key, "curated_measurements", {"active_compounds": "molecule_chembl_id"})
    best = curated.groupBy(key).agg(F.max("pchembl_value").alias("best_pchembl"))
    medians = exact_quantiles(
        curated.filter(F.col(key).isNotNull()),
        [key],
        {"median_potency_nm": "standard_value_nm", "median_pchembl": "pchembl_value"},
    )
    return (
        targets.select(key, "target_name", "organism")
        .join(coverage, key, "left")
        .join(counts, key, "left")
        .join(best, key, "left")
        .join(medians, key, "left")
        .select(
            key,
            "target_name",
            "organism",
            _zero("total_measurements"),
            _zero("total_compounds_tested"),
            _zero("total_assays"),
            _zero("curated_measurements"),
            _zero("active_compounds"),
            "median_potency_nm",
            "median_pchembl",
            "best_pchembl",
        )
    )


def compound_profile(
    facts: DataFrame, curated: DataFrame, compounds: DataFrame, curation: Curation | None = None
) -> DataFrame:
    """Properties plus activity and curated rollups, one row per compound."""
    curation = curation or Curation()
    key = "molecule_chembl_id"
    activity = curation.counts(
        facts, key, "total_measurements", {"targets_tested": "target_chembl_id", "assays_tested": "assay_chembl_id"}
    )
    counts = curation.counts(curated, key, "curated_measurements", {"curated_targets": "target_chembl_id"})
    best = curated.groupBy(key).agg(
        F.max("pchembl_value").alias("best_pchembl"),
        F.min("standard_value_nm").alias("best_potency_nm"),
    )
    return (
        compounds.join(activity, key, "left")
        .join(counts, key, "left")
        .join(best, key, "left")
        .select(
            key,
            F.col("pref_name").alias("compound_name"),
            "canonical_smiles",
            "molecular_weight",
            "alogp",
            "hba",
            "hbd",
            "ro5_violations",
            _zero("total_measurements"),
            _zero("targets_tested"),
            _zero("assays_tested"),
            _zero("curated_measurements"),
            _zero("curated_targets"),
            "best_pchembl",
            "best_potency_nm",
        )
    )


def has_sign():
    return F.col("standard_relation").isNotNull() & (F.col("standard_relation") != "=")


def assay_quality(
    facts: DataFrame,
    assays: DataFrame,
    targets: DataFrame,
    curation: Curation | None = None,
) -> DataFrame:
    """Volume, survival and defects per assay and target.

    Rows are counted on the fact's own keys first; the assay and target texts
    are joined to the counts, not to the measurements.
    """
    curation = curation or Curation()
    counted = facts.groupBy(
        "assay_chembl_id", "assay_key", "target_key", "confidence_score"
    ).agg(
        F.count(F.lit(1)).alias("total_measurements"),
        F.count_if(curation.rules.predicate()).alias("curated_measurements"),
        F.count_if(F.col("standard_value_nm").isNull()).alias("missing_nm_value"),
        F.count_if(F.col("pchembl_value").isNull()).alias("missing_pchembl"),
        F.count_if(F.col("data_validity_comment").isNotNull()).alias("flagged_validity"),
        F.count_if(has_sign()).alias("ambiguous_relation"),
    )
    wide = attach_attributes(
        counted,
        [
            Dimension(assays, "assay_key", "", ("assay_type", "assay_description")),
            Dimension(targets, "target_key", "", ("target_chembl_id", "target_name")),
        ],
    )
    low = F.coalesce(F.col("confidence_score") < curation.min_confidence, F.lit(False))
    return wide.select(
        "assay_chembl_id",
        "assay_type",
        "assay_description",
        "confidence_score",
        "target_chembl_id",
        "target_name",
        "total_measurements",
        "curated_measurements",
        "missing_nm_value",
        "missing_pchembl",
        "flagged_validity",
        "ambiguous_relation",
        low.alias("is_low_confidence"),
    )


# --------------------------------------------------------- data-quality summary
# The names of the metrics below.


def volume() -> list:
    return volume_metrics(
        {
            "total_compounds": "molecule_chembl_id",
            "total_targets": "target_chembl_id",
            "total_assays": "assay_chembl_id",
            "total_documents": "document_chembl_id",
        }
    )


def completeness(curation: Curation) -> list:
    return completeness_metrics(
        {
            "pct_with_normalized_nm": F.col("standard_value_nm").isNotNull(),
            "pct_with_pchembl": F.col("pchembl_value").isNotNull(),
            "pct_curated": curation.rules.predicate(),
        }
    )


def issues(curation: Curation) -> list:
    missing = [
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "standard_value",
        "standard_units",
    ]
    conditions = {f"missing_{c}": F.col(c).isNull() for c in missing}
    conditions |= {
        "unconvertible_units": F.col("standard_value").isNotNull()
        & F.col("standard_value_nm").isNull()
        & F.col("standard_units").isNotNull(),
        "missing_pchembl_value": F.col("pchembl_value").isNull(),
        "ambiguous_relation": has_sign(),
        # only a known score below the bound; the exclusion reason also takes unknown scores
        "low_confidence": F.col("confidence_score") < curation.min_confidence,
        "has_data_validity_comment": F.col("data_validity_comment").isNotNull(),
    }
    return issue_metrics(conditions)


def data_quality_summary(
    facts: DataFrame,
    curation: Curation | None = None,
    measurements: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """All metrics as (metric_group, metric, value): one pass, plus one for replicates.

    ``measurements``, when given, is the staged table behind the fact: replicates
    need no dimension, so they can be counted without any of the fact's joins. ``documents``
    has the document ids of ``facts`` that come without: only they are joined to be counted.
    """
    curation = curation or Curation()
    apart = () if documents is None else ("total_documents",)
    metrics = [*[m for m in volume() if m[1] not in apart], *completeness(curation), *issues(curation)]
    single_pass = long_metrics(facts, [*metrics, *exclusion_metrics(curation.rules)])
    if documents is not None:
        counts = [m for m in volume() if m[1] in apart]
        single_pass = single_pass.unionByName(long_metrics(documents, counts))
    seen = single_pass.filter("metric_group <> 'excluded_by_reason' or value > 0")
    repeated = facts if measurements is None else measurements
    return seen.unionByName(surplus_rows(repeated, REPLICATE_KEYS, "duplicate_measurements"))
