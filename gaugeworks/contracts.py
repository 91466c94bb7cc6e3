"""Declared column contracts of the bronze entities, and their enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table lacks a column its contract requires."""


TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def _struct(spec: str) -> T.StructType:
    """'name type, name type'; needs no session, unlike ``StructType.fromDDL``."""
    pairs = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


ACTIVITY = _struct(
    "activity_id bigint, molecule_chembl_id string, target_chembl_id string, assay_chembl_id string, "
    "document_chembl_id string, standard_type string, standard_relation string, standard_value double, "
    "standard_units string, standard_value_nm double, units_note string, pchembl_value double, "
    "activity_comment string, data_validity_comment string"
)
MOLECULE = _struct(
    "molecule_chembl_id string, pref_name string, canonical_smiles string, molecular_weight double, "
    "alogp double, hba int, hbd int, ro5_violations int"
)
TARGET = _struct("target_chembl_id string, target_name string, organism string, target_type string")
ASSAY = _struct(
    "assay_chembl_id string, assay_type string, assay_description string, confidence_score int, "
    "target_chembl_id string"
)
DOCUMENT = _struct("document_chembl_id string, pubmed_id int, journal string, year int")
SEED = _struct(
    "target_chembl_id string, gene_symbol string, target_name string, organism string, target_type string"
)

ENTITIES = {
    "activity": ACTIVITY,
    "molecule": MOLECULE,
    "target": TARGET,
    "assay": ASSAY,
    "document": DOCUMENT,
}


def enforce_contract(df: DataFrame, schema: T.StructType, name: str = "table") -> DataFrame:
    """Fail on missing columns, drop extra ones, order and cast the rest (bad text -> NULL)."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ContractError(f"{name}: missing columns {', '.join(missing)}")
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[
            F.col(f.name)
            if have[f.name] == f.dataType
            else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def contract_ddl(schema: T.StructType) -> str:
    """The contract as a column list for CREATE TABLE or ``createTableColumnTypes``."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
