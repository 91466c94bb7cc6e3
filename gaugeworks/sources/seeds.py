"""The seed list of in-scope targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.contracts import SEED, ContractError

# The default scope, used when no seed file is given.
DEFAULT_SEEDS = (
    ("CHEMBL203", "EGFR", "Epidermal growth factor receptor erbB1", "Homo sapiens", "SINGLE PROTEIN"),
    (
        "CHEMBL1824",
        "ERBB2",
        "Receptor protein-tyrosine kinase erbB-2 (HER2)",
        "Homo sapiens",
        "SINGLE PROTEIN",
    ),
    (
        "CHEMBL5145",
        "BRAF",
        "Serine/threonine-protein kinase B-raf",
        "Homo sapiens",
        "SINGLE PROTEIN",
    ),
    ("CHEMBL2971", "JAK2", "Tyrosine-protein kinase JAK2", "Homo sapiens", "SINGLE PROTEIN"),
    (
        "CHEMBL279",
        "KDR",
        "Vascular endothelial growth factor receptor 2 (VEGFR2)",
        "Homo sapiens",
        "SINGLE PROTEIN",
    ),
)


def default_seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SEEDS), SEED)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and at least five columns; values are trimmed, short rows are an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if lines.isEmpty():
        raise ContractError(f"empty seed file: {path}")
    if not lines.filter(F.size(F.split("value", ",")) < len(SEED)).isEmpty():
        raise ContractError(f"malformed seed row in {path}")
    rows = spark.read.schema(SEED).option("header", True).csv(path)
    return rows.select(*[F.trim(c).alias(c) for c in SEED.names])
