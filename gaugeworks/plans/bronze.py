"""Bronze: scope the source tables to the seeded targets and project typed entities.

Two inputs are supported: relational source tables (``extract_*``) and nested
JSON records (``project_*``). Both give the columns of ``contracts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.clean import empty_to_null, to_double, to_int
from gaugeworks.functions.units import NANOMOLAR, UnitScale
from gaugeworks.operators.dedup import keep_any
from gaugeworks.session import materialize

# ---------------------------------------------------------------- JSON records


def with_base_value(df: DataFrame, scale: UnitScale = NANOMOLAR) -> DataFrame:
    """Adds ``standard_value_nm`` and ``units_note`` from value and unit."""
    return df.withColumn(
        "standard_value_nm", scale.base_value("standard_value", "standard_units")
    ).withColumn("units_note", scale.note("standard_value", "standard_units"))


def project_activities(records: DataFrame, scale: UnitScale = NANOMOLAR) -> DataFrame:
    text = [
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "document_chembl_id",
        "standard_type",
        "standard_relation",
    ]
    typed = records.select(
        F.col("activity_id").try_cast("bigint").alias("activity_id"),
        *[empty_to_null(c).alias(c) for c in text],
        to_double("standard_value").alias("standard_value"),
        empty_to_null("standard_units").alias("standard_units"),
        to_double("pchembl_value").alias("pchembl_value"),
        empty_to_null("activity_comment").alias("activity_comment"),
        empty_to_null("data_validity_comment").alias("data_validity_comment"),
    )
    return with_base_value(typed, scale).select(
        "activity_id",
        *text,
        "standard_value",
        "standard_units",
        "standard_value_nm",
        "units_note",
        "pchembl_value",
        "activity_comment",
        "data_validity_comment",
    )


def project_molecules(records: DataFrame) -> DataFrame:
    props = "molecule_properties"
    return records.select(
        empty_to_null("molecule_chembl_id").alias("molecule_chembl_id"),
        empty_to_null("pref_name").alias("pref_name"),
        empty_to_null("molecule_structures.canonical_smiles").alias("canonical_smiles"),
        F.coalesce(to_double(f"{props}.full_mwt"), to_double(f"{props}.mw_freebase")).alias(
            "molecular_weight"
        ),
        to_double(f"{props}.alogp").alias("alogp"),
        to_int(f"{props}.hba").alias("hba"),
        to_int(f"{props}.hbd").alias("hbd"),
        to_int(f"{props}.num_ro5_violations").alias("ro5_violations"),
    )


def project_assays(records: DataFrame) -> DataFrame:
    return records.select(
        empty_to_null("assay_chembl_id").alias("assay_chembl_id"),
        empty_to_null("assay_type").alias("assay_type"),
        empty_to_null("description").alias("assay_description"),
        to_int("confidence_score").alias("confidence_score"),
        empty_to_null("target_chembl_id").alias("target_chembl_id"),
    )


def project_documents(records: DataFrame) -> DataFrame:
    return records.select(
        empty_to_null("document_chembl_id").alias("document_chembl_id"),
        to_int("pubmed_id").alias("pubmed_id"),
        empty_to_null("journal").alias("journal"),
        to_int("year").alias("year"),
    )


def enrich_targets(seeds: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every seed once; each field from the fetched record, else from the seed."""
    side = keep_any(
        fetched.select(
            F.col("target_chembl_id").alias("_id"),
            empty_to_null("pref_name").alias("_name"),
            empty_to_null("organism").alias("_organism"),
            empty_to_null("target_type").alias("_type"),
        ).filter(F.col("_id").isNotNull()),
        ["_id"],
    )
    return seeds.join(side, seeds["target_chembl_id"] == side["_id"], "left").select(
        "target_chembl_id",
        F.coalesce("_name", "target_name").alias("target_name"),
        F.coalesce("_organism", "organism").alias("organism"),
        F.coalesce("_type", "target_type").alias("target_type"),
    )


def only_seen(df: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """The rows whose key occurs in another table (a semi-join, no id batches).

    The ids are made distinct first, so a hot key crosses the network once per task.
    """
    ids = seen.select(F.col(seen_key).alias("_seen")).filter(F.col("_seen").isNotNull()).distinct()
    return df.join(ids, df[key] == ids["_seen"], "left_semi")


# ----------------------------------------------------------- relational source
#
# Source columns: target_dictionary(tid, chembl_id, pref_name, organism, target_type),
# assays(assay_id, chembl_id, assay_type, description, confidence_score, tid, doc_id),
# activities(activity_id, assay_id, molregno, doc_id, standard_*, pchembl_value, ...),
# molecule_dictionary(molregno, chembl_id, pref_name), compound_structures, compound_properties,
# docs(doc_id, chembl_id, pubmed_id, journal, year).


def extract_targets(targets: DataFrame, seeds: DataFrame) -> DataFrame:
    return only_seen(targets, "chembl_id", seeds, "target_chembl_id").select(
        F.col("chembl_id").alias("target_chembl_id"),
        F.col("pref_name").alias("target_name"),
        "organism",
        "target_type",
    )


def scope_assays(assays: DataFrame, targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Assays of in-scope targets, with the target id. The scope every extract starts from."""
    in_scope = only_seen(targets, "chembl_id", seeds, "target_chembl_id").select(
        F.col("tid").alias("_tid"), F.col("chembl_id").alias("target_chembl_id")
    )
    return assays.join(in_scope, assays["tid"] == in_scope["_tid"]).drop("_tid")


def extract_assays(scope: DataFrame) -> DataFrame:
    return scope.select(
        F.col("chembl_id").alias("assay_chembl_id"),
        "assay_type",
        F.col("description").alias("assay_description"),
        F.col("confidence_score").try_cast("int").alias("confidence_score"),
        "target_chembl_id",
    )


def scoped_activities(activities: DataFrame, scope: DataFrame) -> DataFrame:
    """The activities of in-scope assays with the assay's and the target's id: the one join on the scope key."""
    side = scope.select(
        F.col("assay_id").alias("_assay"),
        F.col("chembl_id").alias("assay_chembl_id"),
        "target_chembl_id",
    )
    return activities.join(side, activities["assay_id"] == side["_assay"]).drop("_assay")


def extract_activities(
    activities: DataFrame,
    scope: DataFrame,
    molecules: DataFrame,
    docs: DataFrame,
    scale: UnitScale = NANOMOLAR,
    measured: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """See ``typed_activities``. The scope is written, so that the planner knows how small it is."""
    scoped = scoped_activities(activities, materialize(scope))
    return typed_activities(scoped, molecules, docs, scale, measured)


def typed_activities(
    scoped: DataFrame,
    molecules: DataFrame,
    docs: DataFrame,
    scale: UnitScale = NANOMOLAR,
    measured: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """In-scope activities with the ids of their molecule and document, typed and in one unit.

    ``measured`` makes columns that the activities do not store: it gets the joined rows and keeps
    the four ids. It works after the last join, so no shuffle carries what it makes.
    """
    mols = molecules.select(
        F.col("molregno").alias("_mol"), F.col("chembl_id").alias("molecule_chembl_id")
    )
    papers = docs.select(
        F.col("doc_id").alias("_doc"), F.col("chembl_id").alias("document_chembl_id")
    )
    joined = scoped.join(mols, scoped["molregno"] == mols["_mol"]).join(
        papers, scoped["doc_id"] == papers["_doc"], "left"
    )
    joined = measured(joined) if measured else joined
    typed = joined.select(
        "activity_id",
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "document_chembl_id",
        "standard_type",
        "standard_relation",
        F.col("standard_value").cast("double").alias("standard_value"),
        "standard_units",
        F.col("pchembl_value").cast("double").alias("pchembl_value"),
        "activity_comment",
        "data_validity_comment",
    )
    return with_base_value(typed, scale).select(
        *typed.columns[:9], "standard_value_nm", "units_note", *typed.columns[9:]
    )


def extract_molecules(
    molecules: DataFrame,
    structures: DataFrame,
    properties: DataFrame,
    activities: DataFrame,
    scope: DataFrame,
) -> DataFrame:
    """Molecules seen in in-scope activities."""
    tested = only_seen(activities.select("assay_id", "molregno"), "assay_id", scope, "assay_id")
    return tested_molecules(molecules, structures, properties, tested)


def tested_molecules(
    molecules: DataFrame, structures: DataFrame, properties: DataFrame, tested: DataFrame
) -> DataFrame:
    """Molecules that ``tested`` rows name. Scoped before the joins, so they stay small."""
    wanted = only_seen(molecules, "molregno", tested, "molregno")
    shapes = structures.select(F.col("molregno").alias("_s"), "canonical_smiles")
    props = properties.select(
        F.col("molregno").alias("_p"),
        F.coalesce("full_mwt", "mw_freebase").cast("double").alias("molecular_weight"),
        F.col("alogp").cast("double").alias("alogp"),
        F.col("hba").try_cast("int").alias("hba"),
        F.col("hbd").try_cast("int").alias("hbd"),
        F.col("num_ro5_violations").try_cast("int").alias("ro5_violations"),
    )
    return (
        wanted.join(shapes, wanted["molregno"] == shapes["_s"], "left")
        .join(props, wanted["molregno"] == props["_p"], "left")
        .select(
            F.col("chembl_id").alias("molecule_chembl_id"),
            "pref_name",
            "canonical_smiles",
            "molecular_weight",
            "alogp",
            "hba",
            "hbd",
            "ro5_violations",
        )
        .distinct()
    )


def extract_documents(docs: DataFrame, activities: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents named by an in-scope assay or by one of its activities."""
    of_activities = only_seen(activities.select("assay_id", "doc_id"), "assay_id", scope, "assay_id")
    return named_documents(docs, of_activities, scope)


def named_documents(docs: DataFrame, scoped: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents that an assay of the scope or an in-scope activity names."""
    ids = scope.select("doc_id").union(scoped.select("doc_id"))
    return (
        only_seen(docs, "doc_id", ids, "doc_id")
        .select(
            F.col("chembl_id").alias("document_chembl_id"),
            F.col("pubmed_id").try_cast("int").alias("pubmed_id"),
            "journal",
            F.col("year").try_cast("int").alias("year"),
        )
        .distinct()
    )


def extract_entities(
    *,
    seeds: DataFrame,
    targets: DataFrame,
    assays: DataFrame,
    activities: DataFrame,
    molecules: DataFrame,
    structures: DataFrame,
    properties: DataFrame,
    docs: DataFrame,
    measured: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All five bronze entities; ``measured`` as in ``typed_activities``.

    The scope is written once, and so are its activities: they are joined on the scope key
    once, and the extracts that depend on them read the one column they need of what is
    written, without that join and with its real size known to the planner.
    """
    scope = materialize(scope_assays(assays, targets, seeds))
    scoped = materialize(scoped_activities(activities, scope))
    return {
        "target": extract_targets(targets, seeds),
        "assay": extract_assays(scope),
        "activity": typed_activities(scoped, molecules, docs, measured=measured),
        "molecule": tested_molecules(molecules, structures, properties, scoped),
        "document": named_documents(docs, scoped, scope),
    }
