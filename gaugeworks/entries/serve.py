"""Serving queries: profiles, summaries, explanations, lookups, governed SQL, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.entries.registry import query
from gaugeworks.entries.twin import (
    CURATED,
    DQ,
    EDGES,
    PROFILE,
    QUALITY,
    REASON,
    SIMILARITY,
    SUMMARY,
    twin,
)
from gaugeworks.entries.warehouse import Warehouse, load
from gaugeworks.functions.rules import potency_rules
from gaugeworks.operators.audit import (
    BLOCK_COMMENT,
    CTE_PATTERN,
    FORBIDDEN_KEYWORDS,
    FORBIDDEN_PATTERN,
    KEYWORD,
    KEYWORD_PATTERN,
    LIMIT_PATTERN,
    LINE_COMMENT,
    NOT_A_QUERY,
    PATTERN,
    STACKED,
    TABLE,
    TABLE_PATTERN,
    audit_sql_log,
)
from gaugeworks.operators.governed import OPEN_TABLES, governed_sql
from gaugeworks.operators.lookup import (
    GLOSSARY,
    GLOSSARY_ALIASES,
    define_terms,
    glossary_table,
    resolve_names,
)
from gaugeworks.plans import relationships, serving


def _warehouse(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True)


# --------------------------------------------------------------------- profiles


@query(
    "profile_nested",
    twin(
        """select p.molecule_chembl_id, p.compound_name, p.best_pchembl, cast(coalesce(n, 0) as int) as evidence_rows,
             evidence, targets
           from profile p
           left join (select molecule_chembl_id, count(*) as n,
               string_agg(assay_chembl_id || ':' || standard_type, ',' order by place) as evidence
             from (select *, row_number() over (partition by molecule_chembl_id
                     order by pchembl_value desc, activity_id) as place from curated) where place <= 50 group by 1) e
             using (molecule_chembl_id)
           left join (select molecule_chembl_id, string_agg(cast(target_chembl_id as varchar), ',' order by target_chembl_id)
               as targets from edges group by 1) t using (molecule_chembl_id)""",
        CURATED,
        PROFILE,
        EDGES,
        replicates=True,
    ),
)
def profile_nested(spark, sf_dir):
    w = _warehouse(spark, sf_dir)
    nested = serving.nested_profiles(w.profile, w.curated_named)
    evidence, targets = F.col("assay_evidence"), F.col("best_potency_by_target")

    def label(e):
        return F.concat(e["assay_chembl_id"].cast("string"), F.lit(":"), e["standard_type"])

    return nested.select(
        "molecule_chembl_id",
        "compound_name",
        "best_pchembl",
        F.coalesce(F.array_size(evidence), F.lit(0)).alias("evidence_rows"),
        F.array_join(F.transform(evidence, label), ",").alias("evidence"),
        F.array_join(F.transform(targets, lambda t: t["target_chembl_id"].cast("string")), ",").alias(
            "targets"
        ),
    )


@query(
    "best_by_target",
    twin(
        "select molecule_chembl_id, target_chembl_id, target_name, best_pchembl, best_potency_nm from edges",
        CURATED,
        EDGES,
        replicates=True,
    ),
)
def best_by_target(spark, sf_dir):
    return serving.best_by_target(_warehouse(spark, sf_dir).curated_named)


@query(
    "summary_breakdown",
    twin(
        """select target_chembl_id, standard_type, count(*) filter (where pchembl_value is null) as missing_pchembl,
             count(*) as curated_rows from curated group by 1, 2""",
        CURATED,
        replicates=True,
    ),
)
def summary_breakdown(spark, sf_dir):
    return serving.breakdown_by_type(_warehouse(spark, sf_dir).curated_ids)


@query(
    "explain_rows",
    twin(
        f"""select molecule_chembl_id, count(*) as result_count, count(*) filter (where outcome = 'included') as included,
              count(*) filter (where outcome <> 'included') as excluded
            from (select molecule_chembl_id, {REASON} as outcome from fact) group by 1"""
    ),
)
def explain_rows(spark, sf_dir):
    """For every compound: the outcomes of all its rows."""
    outcomes = Warehouse(spark, sf_dir).graded.withColumn("curation_outcome", potency_rules().reason())
    return outcomes.groupBy("molecule_chembl_id").agg(*serving.outcome_counts())


# ---------------------------------------------------------------------- lookups


@query(
    "alias_resolve",
    """select c_custkey, case when c_custkey % 3 = 0 then 'chembl' || c_custkey when c_custkey % 3 = 1 then 'nobody'
           else ' ' || upper(n_name) || ' ' end as asked,
         case when c_custkey % 3 = 0 then 'CHEMBL' || c_custkey when c_custkey % 3 = 1 then null
           else 'CHEMBL' || n_nationkey end as resolved_id
       from customer join nation on c_nationkey = n_nationkey""",
)
def alias_resolve(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    aliases = nation.select(
        F.lower("n_name").alias("alias"),
        F.concat(F.lit("CHEMBL"), F.col("n_nationkey").cast("string")).alias("id"),
    )
    key = F.col("c_custkey")
    asked = (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.when(key % 3 == 0, F.concat(F.lit("chembl"), key.cast("string")))
            .when(key % 3 == 1, "nobody")
            .otherwise(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")))
            .alias("asked"),
        )
    )
    return resolve_names(asked, "asked", aliases)


ASKED_TERMS = (
    "IC50", "ic50", "pChEMBL", "pchembl_value", "confidence score", "Standard-Relation", "standard relation!",
    "data validity comment", "Ki", "kd?", "validity", "logp",
)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED_SQL = "case turn % 12 " + " ".join(
    f"when {i} then {_sql_text(t)}" for i, t in enumerate(ASKED_TERMS)
) + " end"
GLOSSARY_ROWS_SQL = " union all ".join(
    f"select {_sql_text(k)} as lookup, {_sql_text(GLOSSARY[g][0])} as term, {_sql_text(GLOSSARY[g][1])} as definition, "
    f"{_sql_text(GLOSSARY[g][2])} as direction"
    for k, g in [*zip(GLOSSARY, GLOSSARY), *GLOSSARY_ALIASES.items()]
)


@query(
    "glossary_lookup",
    f"""with asked as (select conv_id, turn, {ASKED_SQL.replace("turn % 12", "(conv_id + turn) % 12")} as name
                     from conversations),
       glossary as ({GLOSSARY_ROWS_SQL})
       select conv_id, turn, name, term, definition, direction,
         case when term is null then '{", ".join(sorted(e[0] for e in GLOSSARY.values()))}' end as available
       from asked left join glossary
         on replace(trim(regexp_replace(lower(name), '[^a-z0-9 _]', '', 'g')), ' ', '_') = lookup""",
)
def glossary_lookup(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in ASKED_TERMS])
    asked = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.get(names, ((F.col("conv_id") + F.col("turn")) % 12).cast("int")).alias("name")
    )
    return define_terms(asked, "name", glossary_table(spark))


# ----------------------------------------------------------------- governed SQL

GOVERNED = """select target_name, count(*) as n, round(max(pchembl_value), 2) as best
from mart_compound_target_potency p
where target_chembl_id in (select target_chembl_id from dim_target where target_name is not null)
group by target_name order by n desc, target_name limit 500"""


@query(
    "governed_sql",
    twin(
        """select target_name, count(*) as n, round(max(pchembl_value), 2) as best from curated
           where target_name is not null group by target_name order by n desc, target_name limit 200""",
        CURATED,
        replicates=True,
    ),
)
def governed_sql_entry(spark, sf_dir):
    w = _warehouse(spark, sf_dir)
    w.curated_named.createOrReplaceTempView("mart_compound_target_potency")
    w.dims.target.createOrReplaceTempView("dim_target")
    return governed_sql(spark, GOVERNED).rows


# One statement per kind; {n} is a number from the row.
STATEMENTS = (
    "select compound_name, best_pchembl from mart_compound_profile",
    "select organism from marts.mart_target_activity_summary limit {n}",
    "with few as (select journal from dim_document) select * from few limit 5000",
    "select q.assay_type from mart_assay_quality q join dim_assay s on q.assay_chembl_id = s.assay_chembl_id where q.flagged_validity > {n};",
    "select {n} as seen from dim_compound -- delete from dim_compound",
    "truncate table dim_document",
    "select {n}; select {n} + 1",
    "select units_note from marts.fact_bioactivity_result",
    "select count(*) from silver.stg_assay where confidence_score = {n}",
    "select pg_ls_dir('.')",
    "select relname from pg_catalog.pg_class",
    "delete from dim_assay where confidence_score = {n}",
    "/* {n} */ select sum(shared_compounds) from graph_target_similarity /* alter */",
    "  ",
    "select year from dim_document where journal = 'update {n}'",
    "select (select min(year) from dim_document limit 3) from \"marts\".\"dim_assay\" limit 700",
)


def _statement_sql() -> str:
    cases = " ".join(f"when {i} then {_sql_text(s)}" for i, s in enumerate(STATEMENTS))
    return (
        f"replace(case (conv_id + turn) % {len(STATEMENTS)} {cases} end, '{{n}}', cast(conv_id as varchar))"
    )


OPEN_SQL = "[" + ", ".join(f"'{t}'" for t in OPEN_TABLES) + "]"
KEYWORDS_SQL = "[" + ", ".join(f"'{k}'" for k in FORBIDDEN_KEYWORDS) + "]"


@query(
    "sql_log_audit",
    f"""with log as (select conv_id, turn, {_statement_sql()} as statement from conversations),
       cleaned as (select *, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(statement,
           '{BLOCK_COMMENT}', ' ', 'g'), '{LINE_COMMENT}', ' ', 'g'), '\\s+', ' ', 'g')), ';+$', '')) as clean from log),
       parts as (select *, list_filter(list_transform(string_split(clean, ';'), lambda s: trim(s)), lambda s: s <> '')
                 as parts from cleaned),
       stmts as (select *, coalesce(parts[1], '') as stmt, lower(coalesce(parts[1], '')) as low from parts),
       found as (select *,
           list_transform(regexp_extract_all(stmt, '{TABLE_PATTERN}', 1),
             lambda t: lower(string_split(replace(t, '"', ''), '.')[-1])) as named,
           regexp_extract_all(low, '{CTE_PATTERN}', 1) as ctes,
           list_filter({KEYWORDS_SQL}, lambda k: list_contains(regexp_extract_all(low, '{KEYWORD_PATTERN}', 1), k))[1]
             as keyword,
           regexp_extract(low, '{LIMIT_PATTERN}', 1) as asked
         from stmts),
       closed as (select *, list_filter(named, lambda t: not list_contains(ctes, t) and not list_contains({OPEN_SQL}, t))
                  as closed from found),
       judged as (select *, case when trim(statement) = '' then 'empty query'
           when len(parts) <> 1 then '{STACKED}'
           when not (starts_with(low, 'select') or starts_with(low, 'with')) then '{NOT_A_QUERY}'
           when keyword is not null then '{KEYWORD}' || keyword
           when regexp_matches(low, '{FORBIDDEN_PATTERN}') then '{PATTERN}'
           when len(closed) > 0 then '{TABLE}' || closed[1] end as reason,
           case when asked = '' then 100 else least(coalesce(try_cast(asked as int), 200), 200) end as capped
         from closed)
       select conv_id, turn, statement, reason, case when reason is null then 'accepted' else 'rejected' end as verdict,
         case when reason is null then array_to_string(named, ',') end as referenced_tables,
         case when reason is null then capped end as row_limit,
         case when reason is null then (case when asked = '' then stmt || ' LIMIT ' || capped
           else regexp_replace(stmt, '{LIMIT_PATTERN}', 'LIMIT ' || capped, 'g') end) end as governed_sql
       from judged""",
)
def sql_log_audit(spark, sf_dir):
    kinds = F.array(*[F.lit(s) for s in STATEMENTS])
    kind = ((F.col("conv_id") + F.col("turn")) % len(STATEMENTS)).cast("int")
    log = load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.replace(F.get(kinds, kind), F.lit("{n}"), F.col("conv_id").cast("string")).alias("statement"),
    )
    return audit_sql_log(log, "statement")


# ------------------------------------------------------------------- dashboards

KPIS = (
    "total_compounds", "total_targets", "total_assays", "total_measurements", "pct_with_normalized_nm",
    "pct_with_pchembl", "pct_curated", "missing_standard_units", "missing_pchembl_value", "ambiguous_relation",
    "low_confidence", "unconvertible_units", "duplicate_measurements",
)


@query(
    "kpi_pivot",
    twin(
        "select " + ", ".join(f"max(value) filter (where metric = '{k}') as {k}" for k in KPIS) + " from dq",
        DQ,
        replicates=True,
    ),
)
def kpi_pivot(spark, sf_dir):
    return serving.kpi_board(_warehouse(spark, sf_dir).dq, KPIS)


@query(
    "dashboard_excluded_by_reason",
    twin(
        "select metric as reason, value from dq where metric_group = 'excluded_by_reason'",
        DQ,
        replicates=True,
    ),
)
def dashboard_excluded_by_reason(spark, sf_dir):
    return serving.excluded_by_reason(_warehouse(spark, sf_dir).dq)


def _bar(measure: str, descending: bool = True):
    def run(spark, sf_dir):
        rows = serving.bars(_warehouse(spark, sf_dir).summary, measure, descending=descending)
        return rows.withColumn(measure, F.round(measure, 6)) if measure.startswith("median") else rows

    value = f"round({measure}, 6) as {measure}" if measure.startswith("median") else measure
    sql = twin(f"select target_name, {value} from summary", CURATED, SUMMARY, replicates=True)
    query(f"dashboard_{measure}_by_target", sql)(run)


for _measure in ("total_measurements", "active_compounds", "total_assays"):
    _bar(_measure)
_bar("median_potency_nm", descending=False)

EVIDENCE_TABLE_SQL = """select activity_id, compound_name, target_name, standard_type, standard_value_nm, pchembl_value,
  confidence_score, assay_description, journal, year from curated"""


@query(
    "dashboard_evidence",
    twin(
        f"{EVIDENCE_TABLE_SQL} where standard_type = 'IC50' and pchembl_value >= 3 and confidence_score >= 8",
        CURATED,
        replicates=True,
    ),
)
def dashboard_evidence(spark, sf_dir):
    return serving.evidence_table(
        _warehouse(spark, sf_dir).curated, standard_type="IC50", min_pchembl=3.0, min_confidence=8
    )


@query(
    "dashboard_all_evidence",
    twin(EVIDENCE_TABLE_SQL, CURATED, replicates=True),
)
def dashboard_all_evidence(spark, sf_dir):
    """No parameter given: every optional filter falls away."""
    return serving.evidence_table(_warehouse(spark, sf_dir).curated)


@query(
    "dashboard_best_by_target",
    twin(
        "select target_name, max(pchembl_value) as best_pchembl from curated group by 1",
        CURATED,
        replicates=True,
    ),
)
def dashboard_best_by_target(spark, sf_dir):
    return serving.best_pchembl_by_target(_warehouse(spark, sf_dir).curated_named)


@query(
    "dashboard_publications",
    twin("select distinct journal, year, document_chembl_id from curated", CURATED, replicates=True),
)
def dashboard_publications(spark, sf_dir):
    return serving.publication_lineage(_warehouse(spark, sf_dir).curated)


@query(
    "dashboard_assay_detail",
    twin(
        """select assay_chembl_id, target_name, confidence_score, total_measurements, curated_measurements, missing_pchembl,
             ambiguous_relation from quality""",
        QUALITY,
        replicates=True,
    ),
)
def dashboard_assay_detail(spark, sf_dir):
    return serving.assay_detail(_warehouse(spark, sf_dir).quality)


@query(
    "dashboard_compound_properties",
    twin(
        """select molecule_chembl_id, compound_name, molecular_weight, alogp, hba, hbd, ro5_violations, canonical_smiles
           from profile""",
        CURATED,
        PROFILE,
        replicates=True,
    ),
)
def dashboard_compound_properties(spark, sf_dir):
    return serving.compound_properties(_warehouse(spark, sf_dir).profile)


@query(
    "console_medians",
    twin(
        """select target_name, curated_measurements, round(median_potency_nm, 6) as median_potency_nm,
             round(median_pchembl, 6) as median_pchembl from summary""",
        CURATED,
        SUMMARY,
        replicates=True,
    ),
)
def console_medians(spark, sf_dir):
    return serving.rounded_medians(_warehouse(spark, sf_dir).summary, 6)


@query(
    "rank_within_target",
    twin(
        """select target_chembl_id, activity_id, pchembl_value, cast(rank as int) as rank from (
             select *, row_number() over (partition by target_chembl_id order by pchembl_value desc, activity_id) as rank
             from curated) where rank <= 10""",
        CURATED,
        replicates=True,
    ),
)
def rank_within_target(spark, sf_dir):
    top = serving.top_compounds(_warehouse(spark, sf_dir).curated_ids, 10)
    return top.select("target_chembl_id", "activity_id", "pchembl_value", "rank")


@query(
    "curated_per_target",
    twin("select target_name, count(*) as n from curated group by 1", CURATED, replicates=True),
)
def curated_per_target(spark, sf_dir):
    return serving.curated_counts(_warehouse(spark, sf_dir).curated_named)


@query(
    "top_assays",
    twin(
        """select target_chembl_id, assay_chembl_id, curated_measurements, cast(rank as int) as rank from (
             select *, row_number() over (partition by target_chembl_id order by curated_measurements desc, assay_chembl_id)
               as rank from quality) where rank <= 5""",
        QUALITY,
        replicates=True,
    ),
)
def top_assays(spark, sf_dir):
    top = serving.top_assays(_warehouse(spark, sf_dir).quality, 5)
    return top.select("target_chembl_id", "assay_chembl_id", "curated_measurements", "rank")


@query(
    "compare_targets",
    twin(
        """select target_chembl_id, target_name, total_assays, active_compounds, curated_measurements from summary
           where target_chembl_id in (3, 7)""",
        CURATED,
        SUMMARY,
        replicates=True,
    ),
)
def compare_targets(spark, sf_dir):
    return serving.compare_targets(_warehouse(spark, sf_dir).summary, [3, 7])


@query(
    "semantic_models",
    twin(
        """select 'Curated Potency Evidence' as model, count(*) as n from curated
           union all select 'Target Activity Summary', count(*) from summary
           union all select 'Assay Quality', count(*) from quality
           union all select 'Compound Profile', count(*) from profile
           union all select 'Data Quality Summary', count(*) from dq
           union all select 'Target Similarity', count(*) from similarity
           union all select 'Compound-Target Edges', count(*) from edges""",
        CURATED,
        SUMMARY,
        QUALITY,
        PROFILE,
        DQ,
        EDGES,
        SIMILARITY,
        replicates=True,
    ),
)
def semantic_models(spark, sf_dir):
    w = Warehouse(spark, sf_dir, replicates=True, shared=True)
    names = serving.register_models(
        {
            "mart_compound_target_potency": w.curated,
            "mart_target_activity_summary": w.summary,
            "mart_assay_quality": w.quality,
            "mart_compound_profile": w.profile,
            "mart_data_quality_summary": w.dq,
            "graph_target_similarity": w.similarity,
            "graph_compound_target_edge": relationships.compound_target_edges(w.curated_named),
        }
    )
    counts = [f"select '{n}' as model, count(*) as n from `{n}`" for n in names]
    return spark.sql(" union all ".join(counts))
