"""Run the layers in order, each stage reading the tables of the one before.

A finished stage is a written table, so a lost executor costs one stage at most
and no later plan carries the lineage of an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.operators.postings_index import write_index
from gaugeworks.operators.search import EVIDENCE_TEXT_FIELDS
from gaugeworks.plans import corpus, gold, relationships, serving, silver
from gaugeworks.plans.contract_checks import warehouse_suite
from gaugeworks.session import configure
from gaugeworks.sources.jdbc import JdbcConfig
from gaugeworks.sources.lake import create_layers, publish, write_snapshot

# The stages and their order.
STAGES = ("ingest_bronze", "build_marts", "build_graph", "publish_marts", "build_index")


def ingest_bronze(spark: SparkSession, entities: Mapping[str, DataFrame], fmt: str = "parquet") -> None:
    create_layers(spark)
    for name, df in entities.items():
        write_snapshot(df, f"bronze.{name}", fmt)


def build_marts(
    spark: SparkSession, curation: gold.Curation | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Silver and gold tables; returns the check results."""

    def layer(name: str, df: DataFrame) -> DataFrame:
        write_snapshot(df, name, fmt)
        return spark.table(name)

    bronze = {e: spark.table(f"bronze.{e}") for e in ("activity", "molecule", "target", "assay", "document")}
    activity = layer("silver.stg_activity", silver.stage_activity(bronze["activity"]))
    stg = {
        "compound": layer("silver.stg_compound", silver.stage_compound(bronze["molecule"])),
        "target": layer("silver.stg_target", silver.stage_target(bronze["target"])),
        "assay": layer("silver.stg_assay", silver.stage_assay(bronze["assay"])),
        "document": layer("silver.stg_document", silver.stage_document(bronze["document"])),
    }
    dims = gold.Dimensions(
        layer("gold.dim_compound", gold.dim_compound(stg["compound"])),
        layer("gold.dim_target", gold.dim_target(stg["target"])),
        layer("gold.dim_assay", gold.dim_assay(stg["assay"])),
        layer("gold.dim_document", gold.dim_document(stg["document"])),
    )
    facts = layer("gold.fact_bioactivity_result", gold.fact(activity, dims))
    curated = layer("gold.mart_compound_target_potency", gold.curated_mart(facts, dims, curation))
    summary = gold.target_activity_summary(facts, curated, dims.target, curation)
    layer("gold.mart_target_activity_summary", summary)
    layer("gold.mart_compound_profile", gold.compound_profile(facts, curated, dims.compound, curation))
    layer("gold.mart_assay_quality", gold.assay_quality(facts, dims.assay, dims.target, curation))
    layer("gold.mart_data_quality_summary", gold.data_quality_summary(facts, curation))

    checked = {f"stg_{n}": spark.table(f"silver.stg_{n}") for n in ("activity", *stg)}
    checked |= {
        t.name: spark.table(f"gold.{t.name}")
        for t in spark.catalog.listTables("gold")
        if not t.isTemporary
    }
    checked["bronze_activity"] = bronze["activity"]
    return warehouse_suite(checked, (curation or gold.Curation()).rules)


def build_graph(spark: SparkSession, fmt: str = "parquet") -> None:
    curated = spark.table("gold.mart_compound_target_potency")
    write_snapshot(
        relationships.compound_target_edges(curated), "gold.graph_compound_target_edge", fmt
    )
    write_snapshot(relationships.target_similarity(curated), "gold.graph_target_similarity", fmt)


def build_index(spark: SparkSession, path: str, shards: Sequence[str] = ()) -> None:
    """Evidence documents, embedded passages, and postings of both, as parquet, replaced on every run."""
    curated = spark.table("gold.mart_compound_target_potency")
    serving.evidence_documents(curated).write.mode("overwrite").partitionBy(*shards).parquet(
        f"{path}/evidence"
    )
    passages = corpus.passages(
        spark.table("gold.mart_target_activity_summary"),
        spark.table("gold.graph_target_similarity"),
        spark.table("gold.mart_assay_quality"),
    )
    corpus.embed_passages(passages).write.mode("overwrite").parquet(f"{path}/knowledge")
    corpus.index_passages(spark.read.parquet(f"{path}/knowledge"), f"{path}/knowledge_postings")
    searched = {name: name for name in EVIDENCE_TEXT_FIELDS}
    write_index(spark.read.parquet(f"{path}/evidence"), "doc_id", searched, f"{path}/evidence_postings", cluster="target_chembl_id")


class FailedChecks(RuntimeError):
    """Checks of severity error found violations."""


def checked(results: DataFrame, gate: bool = True) -> DataFrame:
    """Evaluates the checks once, one row each; raises if one failed and ``gate`` is set."""
    rows = results.collect()
    failed = [f"{r['table_name']}.{r['check_name']}: {r['failures']}" for r in rows if r["status"] == "fail"]
    if failed and gate:
        raise FailedChecks("; ".join(failed))
    return results.sparkSession.createDataFrame(rows, results.schema)


def run_stages(
    spark: SparkSession,
    entities: Mapping[str, DataFrame],
    stages: Sequence[str] = STAGES,
    serving_jdbc: JdbcConfig | None = None,
    serving_path: str | None = None,
    index_path: str | None = None,
    curation: gold.Curation | None = None,
    gate: bool = True,
) -> dict[str, object]:
    """Run the named stages one after the other; an unknown name is refused up front.

    A failed check raises ``FailedChecks`` and no later stage runs; ``gate=False`` only
    returns the results. A check that only warns never stops a run.
    """
    configure(spark)
    unknown = [s for s in stages if s not in STAGES]
    if unknown:
        raise ValueError(f"unknown stages {unknown}; known are {list(STAGES)}")
    steps: dict[str, Callable[[], object]] = {
        "ingest_bronze": lambda: ingest_bronze(spark, entities),
        "build_marts": lambda: checked(build_marts(spark, curation), gate),
        "build_graph": lambda: build_graph(spark),
        "publish_marts": lambda: publish(spark, "gold", serving_jdbc, serving_path),
        "build_index": lambda: build_index(spark, index_path) if index_path else None,
    }
    return {stage: steps[stage]() for stage in stages}
