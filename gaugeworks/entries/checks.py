"""Data checks over the benchmark warehouse; each query returns the violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gaugeworks.entries.registry import query
from gaugeworks.entries.twin import CURATED, DQ, PROFILE, QUALITY, REASON, SUMMARY, twin
from gaugeworks.entries.warehouse import Warehouse
from gaugeworks.functions.keys import surrogate_key
from gaugeworks.functions.rules import potency_rules
from gaugeworks.operators import checks
from gaugeworks.plans import gold, silver
from gaugeworks.plans.contract_checks import curated_contract, warehouse_suite
from gaugeworks.plans.gold import REPLICATE_KEYS
from gaugeworks.session import materialize, remove, shuffles_removed, written


def _warehouse(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True)


@query(
    "check_not_null",
    twin("select activity_id, units_note from activity where standard_value_nm is null"),
)
def check_not_null(spark, sf_dir):
    rows = Warehouse(spark, sf_dir).stg_undocumented
    return checks.violating_rows(rows, checks.not_null("standard_value_nm")).select(
        "activity_id", "units_note"
    )


@query(
    "check_unique",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def check_unique(spark, sf_dir):
    line = Warehouse(spark, sf_dir).table("lineitem")
    return checks.unique(line, "l_orderkey", "l_linenumber").violations


@query(
    "check_accepted",
    twin(
        """select activity_id, standard_type from activity
           where standard_relation is not null and standard_type not in ('IC50', 'Ki', 'Kd', 'EC50')"""
    ),
)
def check_accepted(spark, sf_dir):
    check = checks.accepted_values(
        "standard_type", ["IC50", "Ki", "Kd", "EC50"], F.col("standard_relation").isNotNull(), checks.WARN
    )
    rows = Warehouse(spark, sf_dir).stg_undocumented
    return checks.violating_rows(rows, check).select("activity_id", "standard_type")


@query(
    "check_fk",
    """select l_suppkey, count(*) as n from lineitem
       where l_suppkey not in (select s_suppkey from supplier where s_acctbal >= 0) group by 1""",
)
def check_fk(spark, sf_dir):
    w = Warehouse(spark, sf_dir)
    parent = w.table("supplier").filter("s_acctbal >= 0")
    return checks.relationships(w.table("lineitem"), "l_suppkey", parent, "s_suppkey").violations


@query(
    "check_range",
    twin("select activity_id, confidence_score from fact where not (confidence_score between 7 and 9)"),
)
def check_range(spark, sf_dir):
    rows = Warehouse(spark, sf_dir).graded
    return checks.violating_rows(rows, checks.accepted_range("confidence_score", 7, 9)).select(
        "activity_id", "confidence_score"
    )


@query(
    "check_contract",
    twin(
        """select activity_id, standard_type, standard_relation, standard_value_nm, pchembl_value, confidence_score from fact
           where standard_type not in ('IC50', 'Ki', 'Kd', 'EC50') or standard_value_nm is null or standard_value_nm <= 0
             or pchembl_value is null or confidence_score < 7
             or (standard_relation is not null and standard_relation <> '=')"""
    ),
)
def check_contract(spark, sf_dir):
    """The contract re-check on uncurated rows, where it has something to find."""
    rows = Warehouse(spark, sf_dir).graded
    return checks.violating_rows(rows, curated_contract()).select(
        "activity_id",
        "standard_type",
        "standard_relation",
        "standard_value_nm",
        "pchembl_value",
        "confidence_score",
    )


@query(
    "check_reconcile",
    twin(
        f"""select count(*) as total_rows, count(reason) as classified_rows from (select {REASON} as reason from fact)
            having count(*) <> count(reason)"""
    ),
)
def check_reconcile(spark, sf_dir):
    return checks.reconciles(Warehouse(spark, sf_dir).graded, potency_rules().reason()).violations


@query(
    "check_replicates",
    twin(
        """select molecule_chembl_id, target_chembl_id, assay_chembl_id, standard_type, count(*) as n from fact
           group by 1, 2, 3, 4 having count(*) > 1""",
        replicates=True,
    ),
)
def check_replicates(spark, sf_dir):
    rows = _warehouse(spark, sf_dir).stg_undocumented
    return checks.no_repeats(rows, REPLICATE_KEYS, "no_duplicate_measurements").violations


def _suite_sql() -> str:
    def row(table, check, condition, source, severity="error"):
        return (
            f"select '{table}' as table_name, '{check}' as check_name, '{severity}' as severity, "
            f"count(*) filter (where {condition}) as failures from {source}"
        )

    def unique(table, column, source):
        return (
            f"select '{table}', 'unique_{column}', 'error', count(*) from (select {column} from {source} "
            f"where {column} is not null group by 1 having count(*) > 1)"
        )

    keyed = [
        ("stg_activity", "activity_id", "activity"),
        ("stg_compound", "molecule_chembl_id", "dim_compound"),
        ("stg_target", "target_chembl_id", "dim_target"),
        ("stg_assay", "assay_chembl_id", "dim_assay"),
        ("stg_document", "document_chembl_id", "dim_document"),
        ("dim_compound", "compound_key", "dim_compound"),
        ("dim_compound", "molecule_chembl_id", "dim_compound"),
        ("dim_target", "target_key", "dim_target"),
        ("dim_target", "target_chembl_id", "dim_target"),
        ("dim_assay", "assay_key", "dim_assay"),
        ("dim_assay", "assay_chembl_id", "dim_assay"),
        ("dim_document", "document_key", "dim_document"),
        ("dim_document", "document_chembl_id", "dim_document"),
        ("fact_bioactivity_result", "activity_id", "fact"),
        ("mart_compound_target_potency", "activity_id", "curated"),
        ("mart_target_activity_summary", "target_chembl_id", "summary"),
        ("mart_compound_profile", "molecule_chembl_id", "profile"),
    ]
    parts = [row(t, f"not_null_{c}", f"{c} is null", s) for t, c, s in keyed]
    parts += [unique(t, c, s) for t, c, s in keyed]
    mart, contract = "mart_compound_target_potency", "('IC50', 'Ki', 'Kd', 'EC50')"
    parts += [
        row("bronze_activity", "not_null_activity_id", "activity_id is null", "activity"),
        row("stg_activity", "accepted_values_standard_relation",
            "standard_relation not in ('=', '>', '<', '>=', '<=', '~')", "activity", "warn"),
        row("dim_assay", "accepted_range_confidence_score", "confidence_score < 0 or confidence_score > 9",
            "dim_assay", "warn"),
        f"""select 'fact_bioactivity_result', 'reasons_reconcile', 'error',
              cast(count(*) <> count(reason) as bigint) from (select {REASON} as reason from fact)""",
        "select 'fact_bioactivity_result', 'relationships_target_key', 'error', count(distinct target_key) from fact "
        "where target_key not in (select target_key from dim_target)",
        "select 'fact_bioactivity_result', 'relationships_compound_key', 'error', count(distinct compound_key) from fact "
        "where compound_key not in (select compound_key from dim_compound)",
        row(mart, "not_null_standard_value_nm", "standard_value_nm is null", "curated"),
        row(mart, "not_null_pchembl_value", "pchembl_value is null", "curated"),
        row(mart, "accepted_values_standard_type", f"standard_type not in {contract}", "curated"),
        row(mart, "accepted_range_confidence_score", "confidence_score < 7 or confidence_score > 9", "curated"),
        row(mart, "accepted_values_standard_relation", "standard_relation <> '='", "curated"),
        row(mart, "curated_is_comparable", f"standard_type not in {contract} or standard_value_nm <= 0 "
            "or confidence_score < 7 or standard_relation <> '='", "curated"),
        f"""select '{mart}', 'no_duplicate_measurements', 'error', count(*) from (
              select 1 from curated group by molecule_chembl_id, target_chembl_id, assay_chembl_id, standard_type
              having count(*) > 1)""",
        row("mart_assay_quality", "not_null_assay_chembl_id", "assay_chembl_id is null", "quality"),
        """select 'mart_assay_quality', 'unique_assay_and_target', 'error', count(*) from (
             select 1 from quality group by assay_chembl_id, target_chembl_id having count(*) > 1)""",
        row("mart_data_quality_summary", "not_null_value", "value is null", "dq"),
    ]
    union = " union all ".join(parts)
    return twin(
        f"""select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status
            from ({union})""",
        CURATED,
        SUMMARY,
        PROFILE,
        QUALITY,
        DQ,
        replicates=True,
    )


# The most turns in which measurements are staged and joined, and line items that are worth one.
MOST_TURNS = 8
LINES_A_TURN = 500_000
# Keys of the fact that are hashes of a natural id, where that is known.
HASHED = {
    "compound_key": "molecule_chembl_id",
    "target_key": "target_chembl_id",
    "assay_key": "assay_chembl_id",
    "document_key": "document_chembl_id",
}


def _in_turns(df, turns):
    """The rows of ``df`` in ``turns`` parts, each written before the next one is made; with the paths."""
    turn = F.pmod(F.xxhash64("molecule_chembl_id", "assay_chembl_id"), F.lit(turns))
    return [written(df.filter(turn == t), codec="zstd") for t in range(turns)]


def _stored_facts(facts):
    """``facts`` written without their hashes, which are long and do not compress: only whether there is one."""
    stored, _ = written(facts.withColumns({key: F.col(key).isNotNull() for key in HASHED}), codec="zstd")
    return stored.withColumns({key: F.when(F.col(key), surrogate_key(natural)) for key, natural in HASHED.items()})


def _together(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("check_suite", _suite_sql())
def check_suite(spark, sf_dir):
    """Every check of every table, each in a job of its own that leaves no shuffle files.

    Measurements are staged and joined in turns, and a turn's staged rows go when its facts are
    written, so the joins never hold all of them at once.
    """
    w = _warehouse(spark, sf_dir)
    with shuffles_removed(spark):
        dims = w.dims
        turns = max(1, min(MOST_TURNS, -(-w.table("lineitem").count() // LINES_A_TURN)))
        staged = _in_turns(w.stg_activity, turns)
        results = [
            warehouse_suite(
                {
                    "bronze_activity": w.activity,
                    "stg_activity": _together([part for part, _ in staged]),
                    "stg_compound": silver.stage_compound(w.molecule),
                    "stg_target": silver.stage_target(w.target),
                    "stg_assay": silver.stage_assay(w.assay),
                    "stg_document": silver.stage_document(w.document),
                    "dim_compound": dims.compound,
                    "dim_target": dims.target,
                    "dim_assay": dims.assay,
                    "dim_document": dims.document,
                },
                one_by_one=True,
            )
        ]
        parts = []
        for part, path in staged:
            parts.append(_stored_facts(gold.fact(part, dims)))
            remove(spark, path)
        facts = _together(parts)
        curated = materialize(gold.curated_mart(facts, dims))
        apart = gold.Curation(apart=True)
        results.append(
            warehouse_suite(
                {
                    "fact_bioactivity_result": facts,
                    "mart_compound_target_potency": curated,
                    "mart_target_activity_summary": materialize(gold.target_activity_summary(facts, curated, dims.target, apart)),
                    "mart_compound_profile": materialize(gold.compound_profile(facts, curated, dims.compound, apart)),
                    "mart_assay_quality": materialize(gold.assay_quality(facts, dims.assay, dims.target)),
                    "mart_data_quality_summary": gold.data_quality_summary(facts),
                },
                parents={"dim_target": dims.target, "dim_compound": dims.compound},
                one_by_one=True,
            )
        )
    return _together(results)
