"""Page files of the form ``{"page_meta": {...}, "<collection>": [record, ...]}``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Collection keys, and filter keys that only steer paging.
COLLECTIONS = {
    "activity": "activities",
    "molecule": "molecules",
    "target": "targets",
    "assay": "assays",
    "document": "documents",
}
PAGING_KEYS = ("format", "limit", "offset")

# Numbers may arrive as JSON strings, so every leaf is read as text.
RAW_RECORDS = {
    "activity": (
        "activity_id string, molecule_chembl_id string, target_chembl_id string, assay_chembl_id string, "
        "document_chembl_id string, standard_type string, standard_relation string, standard_value string, "
        "standard_units string, pchembl_value string, activity_comment string, data_validity_comment string"
    ),
    "molecule": (
        "molecule_chembl_id string, pref_name string, "
        "molecule_structures struct<canonical_smiles: string>, "
        "molecule_properties struct<full_mwt: string, mw_freebase: string, alogp: string, hba: string, "
        "hbd: string, num_ro5_violations: string>"
    ),
    "target": "target_chembl_id string, pref_name string, organism string, target_type string",
    "assay": (
        "assay_chembl_id string, assay_type string, description string, confidence_score string, "
        "target_chembl_id string"
    ),
    "document": "document_chembl_id string, pubmed_id string, journal string, year string",
}


def read_pages(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """One row per record. Pages are whole files, so parallelism is one task per page.

    A page that cannot be parsed, or that lacks its collection, fails the read.
    """
    collection = COLLECTIONS[entity]
    record = T.StructType.fromDDL(RAW_RECORDS[entity])
    schema = T.StructType([T.StructField(collection, T.ArrayType(record))])
    pages = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.lit(f"a page has no collection {collection}")).cast(schema[collection].dataType)
    return pages.select(F.explode(F.coalesce(collection, missing)).alias("r")).select("r.*")


def filter_records(df: DataFrame, params: Mapping[str, str]) -> DataFrame:
    """Exact ``field=value`` and ``field__in=a,b,c`` filters; paging keys are ignored."""
    for key, value in params.items():
        if key in PAGING_KEYS:
            continue
        if key.endswith("__in"):
            allowed = [v.strip() for v in value.split(",")]
            df = df.filter(F.col(key.removesuffix("__in")).isin(allowed))
        else:
            df = df.filter(F.col(key) == value)
    return df
