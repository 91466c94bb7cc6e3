"""Small reference lookups: entity aliases and the metric glossary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names by which the seeded targets are asked for.
TARGET_ALIASES = {
    "egfr": "CHEMBL203",
    "her2": "CHEMBL1824",
    "erbb2": "CHEMBL1824",
    "braf": "CHEMBL5145",
    "jak2": "CHEMBL2971",
    "vegfr2": "CHEMBL279",
    "kdr": "CHEMBL279",
}
ID_PREFIX = "CHEMBL"


def resolve_name(name: str | None, aliases: Mapping[str, str] | None = None) -> str | None:
    """The id behind a name: ids pass through upper-cased, aliases are looked up."""
    text = (name or "").strip()
    if text.upper().startswith(ID_PREFIX):
        return text.upper()
    return (TARGET_ALIASES if aliases is None else aliases).get(text.lower())


def resolve_names(
    requests: DataFrame, column: str, aliases: DataFrame, id_prefix: str = ID_PREFIX
) -> DataFrame:
    """Batch form: adds ``resolved_id``; ``aliases`` holds (alias, id), alias in lower case."""
    name = F.trim(column)
    table = aliases.select(F.col("alias").alias("_alias"), F.col("id").alias("_id"))
    joined = requests.join(table, F.lower(name) == F.col("_alias"), "left")
    by_id = F.when(F.upper(name).startswith(id_prefix), F.upper(name))
    return joined.withColumn("resolved_id", F.coalesce(by_id, F.col("_id"))).drop("_alias", "_id")


def alias_table(spark: SparkSession, aliases: Mapping[str, str] | None = None) -> DataFrame:
    pairs = list((TARGET_ALIASES if aliases is None else aliases).items())
    return spark.createDataFrame(pairs, "alias string, id string")


# The terms and keys are fixed values; the wording of the definitions is ours.
GLOSSARY = {
    "ic50": (
        "IC50",
        "Concentration at which a compound halves a measured activity. Stored in nM.",
        "a low value means potent",
    ),
    "ki": (
        "Ki",
        "Equilibrium constant for an inhibitor binding its target. Stored in nM.",
        "a low value means tight binding",
    ),
    "kd": (
        "Kd",
        "Concentration at which half of the target is occupied at equilibrium. Stored in nM.",
        "a low value means high affinity",
    ),
    "ec50": (
        "EC50",
        "Concentration that gives half of the largest effect a compound reaches. Stored in nM.",
        "a low value means potent",
    ),
    "pchembl": (
        "pChEMBL value",
        "Minus the base-10 logarithm of a molar activity value, so 7 stands for 100 nM.",
        "a high value means potent",
    ),
    "confidence_score": (
        "Assay confidence score",
        "A 0 to 9 grade of how directly an assay is tied to its target; 7 or more is curated.",
        "a high value means a reliable link to the target",
    ),
    "standard_relation": (
        "Standard relation",
        "The sign in front of a measured value; only '=' or no sign counts as comparable.",
        "only an exact value is curated",
    ),
    "data_validity_comment": (
        "Data validity comment",
        "A note that a measurement may be wrong; a row with such a note is not curated.",
        "a comment keeps the row out of the curated mart",
    ),
}

# Other names for the glossary keys.
GLOSSARY_ALIASES = {
    "pchembl_value": "pchembl",
    "confidence": "confidence_score",
    "relation": "standard_relation",
    "validity": "data_validity_comment",
}

NOT_A_NAME = "[^a-z0-9 _]"


def glossary_table(spark: SparkSession) -> DataFrame:
    """(lookup, term, definition, direction): one row per key and per alias."""
    rows = [(key, *entry) for key, entry in GLOSSARY.items()]
    rows += [(alias, *GLOSSARY[key]) for alias, key in GLOSSARY_ALIASES.items()]
    return spark.createDataFrame(
        rows, "lookup string, term string, definition string, direction string"
    )


def lookup_key(column):
    """Lower case, no punctuation, words joined by '_'."""
    kept = F.trim(F.regexp_replace(F.lower(column), NOT_A_NAME, ""))
    return F.replace(kept, F.lit(" "), F.lit("_"))


def define_terms(requests: DataFrame, column: str, glossary: DataFrame) -> DataFrame:
    """Adds term, definition, direction; for an unknown name, ``available`` lists the terms."""
    terms = ", ".join(sorted(entry[0] for entry in GLOSSARY.values()))
    joined = requests.join(glossary, lookup_key(F.col(column)) == F.col("lookup"), "left")
    return joined.drop("lookup").withColumn(
        "available", F.when(F.col("term").isNull(), F.lit(terms))
    )
