"""Silver and gold queries: staging, keys, dimensions, fact, curation, marts, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.entries.registry import query
from gaugeworks.entries.twin import (
    COMPLETENESS,
    CURATED,
    DIM_COMPOUND,
    DIM_DOCUMENT,
    DIM_TARGET,
    DQ,
    DUPLICATES,
    EXCLUDED,
    ISSUES,
    PREDICATE,
    PROFILE,
    QUALITY,
    REASON,
    SUMMARY,
    VOLUME,
    dim_assay,
    twin,
)
from gaugeworks.entries.warehouse import Warehouse, load
from gaugeworks.functions.keys import surrogate_key
from gaugeworks.functions.rules import TYPE_REASON, potency_rules
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.operators.quality import exclusion_histogram, long_metrics, surplus_rows
from gaugeworks.plans import gold, silver

RULES = potency_rules()
CURATION = gold.Curation()


@query(
    "stage_clean",
    """select cast(l_orderkey as bigint) as order_id, l_linenumber as line_no, l_partkey as part_id,
         nullif(trim(case when l_linenumber % 3 = 0 then '  ' when l_linenumber % 3 = 1 then ' ' || l_returnflag || ' '
           else l_returnflag end), '') as standard_type,
         nullif(trim(case when l_tax < 0.02 then '' else '=' end), '') as standard_relation,
         case when l_quantity = 2 then null else l_extendedprice end as standard_value,
         count(*) as n
       from lineitem group by all""",
)
def stage_clean(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    raw = line.select(
        F.col("l_orderkey").alias("activity_id"),
        number.alias("molecule_chembl_id"),
        F.col("l_partkey").alias("target_chembl_id"),
        none.alias("assay_chembl_id"),
        none.alias("document_chembl_id"),
        F.when(number % 3 == 0, "  ")
        .when(number % 3 == 1, F.concat(F.lit(" "), flag, F.lit(" ")))
        .otherwise(flag)
        .alias("standard_type"),
        F.when(F.col("l_tax") < 0.02, "").otherwise("=").alias("standard_relation"),
        F.when(F.col("l_quantity") == 2, F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice"))
        .alias("standard_value"),
        none.alias("standard_units"),
        F.lit(None).cast("double").alias("standard_value_nm"),
        none.alias("units_note"),
        F.lit(None).cast("double").alias("pchembl_value"),
        none.alias("activity_comment"),
        none.alias("data_validity_comment"),
    )
    return (
        silver.stage_activity(raw)
        .groupBy(
            F.col("activity_id").alias("order_id"),
            F.col("molecule_chembl_id").alias("line_no"),
            F.col("target_chembl_id").alias("part_id"),
            "standard_type",
            "standard_relation",
            "standard_value",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "stage_dedup",
    """with cleaned as (
         select o_custkey as document_chembl_id, cast(o_orderkey as int) as pubmed_id,
           nullif(trim(case when o_orderstatus = 'P' then ' ' else o_orderpriority end), '') as journal,
           cast(year(o_orderdate) as int) as year
         from orders)
       select document_chembl_id, pubmed_id, journal, year from (
         select *, row_number() over (partition by document_chembl_id
           order by pubmed_id asc nulls last, journal asc nulls last, year asc nulls last) as rn from cleaned)
       where rn = 1""",
)
def stage_dedup(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    pulls = orders.select(
        F.col("o_custkey").alias("document_chembl_id"),
        F.col("o_orderkey").alias("pubmed_id"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("journal"),
        F.year("o_orderdate").alias("year"),
    )
    return silver.stage_document(pulls)


@query(
    "stage_compound",
    """with pulls as (
         select l_partkey as molecule_chembl_id, case when l_linenumber = 1 then '' else p_name end as pref_name,
           p_type as canonical_smiles, l_extendedprice as molecular_weight, l_discount as alogp, p_size as hba,
           l_linenumber as hbd, cast(l_quantity as int) as ro5_violations
         from lineitem left join part on l_partkey = p_partkey)
       select * exclude (rn) from (
         select molecule_chembl_id, nullif(trim(pref_name), '') as pref_name, canonical_smiles, molecular_weight, alogp,
           hba, hbd, ro5_violations, row_number() over (partition by molecule_chembl_id order by
             nullif(trim(pref_name), '') asc nulls last, canonical_smiles asc nulls last, molecular_weight asc nulls last,
             alogp asc nulls last, hba asc nulls last, hbd asc nulls last, ro5_violations asc nulls last) as rn
         from pulls) where rn = 1""",
)
def stage_compound(spark, sf_dir):
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    pulls = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_partkey").alias("molecule_chembl_id"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("p_name")).alias("pref_name"),
        F.col("p_type").alias("canonical_smiles"),
        F.col("l_extendedprice").alias("molecular_weight"),
        F.col("l_discount").alias("alogp"),
        F.col("p_size").alias("hba"),
        F.col("l_linenumber").alias("hbd"),
        F.col("l_quantity").alias("ro5_violations"),
    )
    return silver.stage_compound(pulls)


@query(
    "stage_assay",
    """with cleaned as (
         select l_orderkey as assay_chembl_id, nullif(trim(l_linestatus || ' '), '') as assay_type,
           nullif(trim(case when l_linenumber % 2 = 0 then ' ' else l_returnflag end), '') as assay_description,
           l_linenumber as confidence_score, l_suppkey as target_chembl_id
         from lineitem)
       select assay_chembl_id, assay_type, assay_description, confidence_score, target_chembl_id from (
         select *, row_number() over (partition by assay_chembl_id order by assay_type asc nulls last,
           assay_description asc nulls last, confidence_score asc nulls last, target_chembl_id asc nulls last) as rn
         from cleaned) where rn = 1""",
)
def stage_assay(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    pulls = line.select(
        F.col("l_orderkey").alias("assay_chembl_id"),
        F.concat("l_linestatus", F.lit(" ")).alias("assay_type"),
        F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("l_returnflag")).alias("assay_description"),
        F.col("l_linenumber").cast("string").alias("confidence_score"),
        F.col("l_suppkey").alias("target_chembl_id"),
    )
    return silver.stage_assay(pulls)


@query(
    "stage_target",
    """with cleaned as (
         select c_nationkey as target_chembl_id, nullif(trim(case when c_custkey % 2 = 0 then '' else c_name end), '')
           as target_name, c_mktsegment as organism, cast(null as varchar) as target_type
         from customer)
       select target_chembl_id, target_name, organism, target_type from (
         select *, row_number() over (partition by target_chembl_id order by target_name asc nulls last,
           organism asc nulls last) as rn from cleaned) where rn = 1""",
)
def stage_target(spark, sf_dir):
    pulls = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("target_chembl_id"),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("target_name"),
        F.concat(F.lit(" "), "c_mktsegment").alias("organism"),
        F.lit("  ").alias("target_type"),
    )
    return silver.stage_target(pulls)


@query(
    "surrogate_keys",
    """select l_orderkey, l_linenumber, l_partkey,
         md5(coalesce(cast(l_orderkey as varchar), '_dbt_utils_surrogate_key_null_') || '-' ||
             coalesce(cast(case when l_linenumber > 3 then l_linenumber end as varchar), '_dbt_utils_surrogate_key_null_')
             || '-' || l_returnflag) as line_key
       from lineitem""",
)
def surrogate_keys(spark, sf_dir):
    some_line = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber"))
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        surrogate_key("l_orderkey", some_line, "l_returnflag").alias("line_key"),
    )


@query("dim_compound", f"with {DIM_COMPOUND} select * from dim_compound")
def dim_compound(spark, sf_dir):
    return Warehouse(spark, sf_dir).dims.compound


@query("dim_target", f"with {DIM_TARGET} select * from dim_target")
def dim_target(spark, sf_dir):
    return Warehouse(spark, sf_dir).dims.target


@query("dim_assay", f"with {dim_assay()} select * from dim_assay")
def dim_assay_entry(spark, sf_dir):
    return Warehouse(spark, sf_dir).dims.assay


@query("dim_document", f"with {DIM_DOCUMENT} select * from dim_document")
def dim_document(spark, sf_dir):
    return Warehouse(spark, sf_dir).dims.document


@query("fact_star", twin("select * from fact"))
def fact_star(spark, sf_dir):
    return Warehouse(spark, sf_dir).facts


@query(
    "curated_predicate",
    twin(f"select activity_id, standard_type, pchembl_value from fact where {PREDICATE}"),
)
def curated_predicate(spark, sf_dir):
    facts = Warehouse(spark, sf_dir).graded
    return facts.filter(RULES.predicate()).select("activity_id", "standard_type", "pchembl_value")


@query(
    "exclusion_reason",
    twin(
        f"select activity_id, {REASON} as outcome, "
        f"{REASON.replace('standard_type is null or ', '')} as lenient_outcome from fact"
    ),
)
def exclusion_reason(spark, sf_dir):
    return Warehouse(spark, sf_dir).graded.select(
        "activity_id",
        RULES.reason().alias("outcome"),
        RULES.reason(unknown_passes=[TYPE_REASON]).alias("lenient_outcome"),
    )


@query("curated_mart", twin("select * from curated", CURATED, replicates=True))
def curated_mart(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True).curated


ROUNDED_SUMMARY = (
    "select * replace (round(median_potency_nm, 6) as median_potency_nm, "
    "round(median_pchembl, 6) as median_pchembl) from summary"
)


def _rounded(summary):
    return summary.withColumns(
        {c: F.round(c, 6) for c in ("median_potency_nm", "median_pchembl")}
    )


@query("target_activity_summary", twin(ROUNDED_SUMMARY, CURATED, SUMMARY))
def target_activity_summary(spark, sf_dir):
    return _rounded(Warehouse(spark, sf_dir).summary)


@query(
    "target_activity_summary_replicates",
    twin(ROUNDED_SUMMARY, CURATED, SUMMARY, replicates=True),
)
def target_activity_summary_replicates(spark, sf_dir):
    return _rounded(Warehouse(spark, sf_dir, replicates=True).summary)


@query("compound_profile", twin("select * from profile", CURATED, PROFILE, replicates=True))
def compound_profile(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True).profile


@query("assay_quality", twin("select * from quality", QUALITY))
def assay_quality(spark, sf_dir):
    return Warehouse(spark, sf_dir).quality


@query("dq_volume", twin(VOLUME))
def dq_volume(spark, sf_dir):
    return long_metrics(Warehouse(spark, sf_dir).stg_activity, gold.volume())


@query("dq_completeness", twin(COMPLETENESS))
def dq_completeness(spark, sf_dir):
    return long_metrics(Warehouse(spark, sf_dir).graded, gold.completeness(CURATION))


@query("dq_issues", twin(ISSUES))
def dq_issues(spark, sf_dir):
    return long_metrics(Warehouse(spark, sf_dir).graded, gold.issues(CURATION))


@query("dq_duplicates", twin(DUPLICATES, replicates=True))
def dq_duplicates(spark, sf_dir):
    facts = Warehouse(spark, sf_dir, replicates=True).stg_undocumented
    return surplus_rows(facts, gold.REPLICATE_KEYS, "duplicate_measurements")


@query("dq_excluded", twin(EXCLUDED))
def dq_excluded(spark, sf_dir):
    found = exclusion_histogram(Warehouse(spark, sf_dir).graded, RULES)
    return found.select(
        F.lit("excluded_by_reason").alias("metric_group"),
        F.col("exclusion_reason").alias("metric"),
        F.col("row_count").cast("double").alias("value"),
    )


@query("dq_summary", twin("select * from dq", DQ, replicates=True))
def dq_summary(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True).dq


@query(
    "quantiles_any_scale",
    """select l_returnflag as flag,
         round(quantile_cont(7 + l_extendedprice * 1e-10, 0.5), 12) as narrow,
         round(quantile_cont(l_extendedprice * 1e-9, 0.5) * 1e9, 6) as tiny,
         round(quantile_cont(l_discount, 0.5), 6) as few
       from lineitem group by all""",
)
def quantiles_any_scale(spark, sf_dir):
    """Exact medians of a narrow band, of very small values and of few distinct ones."""
    line = load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        (F.lit(7) + F.col("l_extendedprice") * F.lit(1e-10)).alias("band"),
        (F.col("l_extendedprice") * F.lit(1e-9)).alias("scaled"),
        "l_discount",
    )
    medians = exact_quantiles(line, ["flag"], {"narrow": "band", "tiny": "scaled", "few": "l_discount"})
    return medians.select(
        "flag",
        F.round("narrow", 12).alias("narrow"),
        F.round(F.col("tiny") * F.lit(1e9), 6).alias("tiny"),
        F.round("few", 6).alias("few"),
    )
