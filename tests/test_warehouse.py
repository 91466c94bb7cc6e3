"""Page files to published marts, on a small set with every awkward row."""

import json

import pytest

from gaugeworks import contracts
from gaugeworks.functions.rules import potency_rules
from gaugeworks.operators.governed import governed_sql
from gaugeworks.plans.contract_checks import warehouse_suite
from gaugeworks.plans import bronze, corpus, gold, relationships, serving, silver, stages
from gaugeworks.sources import catalog, jdbc, json_pages, lake, seeds

# id, molecule, target, assay, document, type, relation, value, unit, pchembl, validity
ACTIVITIES = [
    (1, "M1", "T1", "A1", "D1", "IC50", "=", "2.0", "nM", "8.70", None),
    (2, "M2", "T1", "A1", "D1", "IC50", "=", "0.03", "uM", "7.52", None),
    (3, "M2", "T1", "A2", "D1", "IC50", ">", "1000", "nM", None, None),
    (4, "M3", "T2", "A3", "D2", "Ki", "=", 9.0, "nM", 8.05, None),
    (5, "M1", "T2", "A3", "D2", "Kd", "", "5", " nM ", "8.30", ""),
    (6, "M1", "T3", "A4", "D3", "EC50", None, "31", "nM", "7.51", None),
    (7, "M3", "T3", "A5", "D3", "IC50", "=", "4", "ug.mL-1", None, "outside range"),
    (8, "M1", "T1", "A1", "D1", "IC50", "=", "2.4", "nM", "8.62", None),  # replicate of 1
    (9, "M3", "T3", "A6", "D3", "IC50", "=", "200", "nM", "6.70", None),  # low confidence
    (10, "M3", "T3", "A7", "D3", "IC50", "=", "20", "nM", "7.70", None),  # unknown confidence
    (11, "M9", "T9", "A9", "D9", "IC50", "=", "20", "nM", "7.70", None),  # nothing is known
    (12, "M1", "T1", "A1", "D1", None, "=", "1", "nM", "9.0", None),  # no type
    (13, "M2", "T2", "A3", "D2", "Inhibition", "=", "50", "%", None, None),
    (14, "M2", "T2", "A3", "D2", "IC50", "~", "50", "nM", "7.30", None),
    (15, "M2", "T2", "A3", "D2", "IC50", "=", None, None, None, None),
    (16, "M2", "T3", "A4", "D2", "IC50", "=", "6", "nM", "8.22", "flagged"),
    (17, "M2", "T2", "A3", "D2", "Ki", "=", "8", "nM", "8.10", None),
    (18, "M2", "T2", "A3", "D2", "Ki", "=", "8", "nM", "8.10", None),  # equal but for the id
    (None, "M2", "T2", "A3", "D2", "Ki", "=", "8", "nM", "8.10", None),
]
OUTCOMES = {
    1: "included", 2: "included", 3: "missing_pchembl_value", 4: "included", 5: "included", 6: "included",
    7: "missing_or_unconvertible_nm_value", 8: "included", 9: "low_confidence_score", 10: "low_confidence_score",
    11: "low_confidence_score", 12: "non_curated_standard_type", 13: "non_curated_standard_type",
    14: "ambiguous_standard_relation", 15: "missing_or_unconvertible_nm_value", 16: "data_validity_comment_present",
    17: "included", 18: "included",
}
CURATED_IDS = {1, 2, 4, 5, 6, 17}

MOLECULES = [
    ("M1", "ONE", {"canonical_smiles": "C"}, {"full_mwt": "446.90", "alogp": "4.15", "hba": "7", "hbd": "1", "num_ro5_violations": "0"}),
    ("M2", "", {"canonical_smiles": "CC"}, {"full_mwt": None, "mw_freebase": "10.5", "alogp": "NaN", "hba": "7.0"}),
    ("M3", "THREE", None, None),
    ("M3", "ALIAS", None, None),
]
ASSAYS = [("A1", 9), ("A2", 8), ("A3", 9), ("A4", 8), ("A5", 9), ("A6", 5), ("A7", None)]
TARGETS = [("T1", "Alpha kinase"), ("T2", ""), ("T3", "Gamma kinase")]
SEEDS = "target,gene,name,organism,type\nT1,G1,Seed one,Homo sapiens,SINGLE PROTEIN\nT2, G2 , Seed two ,Homo sapiens,SINGLE PROTEIN\n\nT3,G3,Seed three,Homo sapiens,SINGLE PROTEIN\n"


def write_pages(root):
    names = (
        "activity_id molecule_chembl_id target_chembl_id assay_chembl_id document_chembl_id standard_type "
        "standard_relation standard_value standard_units pchembl_value data_validity_comment"
    ).split()
    pages = {
        "activities": [dict(zip(names, a)) | {"extra": 1} for a in ACTIVITIES],
        "molecules": [
            {"molecule_chembl_id": m, "pref_name": n, "molecule_structures": s, "molecule_properties": p}
            for m, n, s, p in MOLECULES
        ],
        "assays": [
            {"assay_chembl_id": a, "assay_type": "B", "description": f"Assay {a} of kinase", "confidence_score": c}
            for a, c in ASSAYS
        ],
        "documents": [{"document_chembl_id": f"D{i}", "pubmed_id": 100 + i, "journal": "J", "year": 2000 + i} for i in (1, 2, 3)],
        "targets": [{"target_chembl_id": t, "pref_name": n, "organism": "Homo sapiens"} for t, n in TARGETS],
    }
    for collection, records in pages.items():
        (root / collection).mkdir()
        half = len(records) // 2
        for i, part in enumerate((records[:half], records[half:])):
            text = json.dumps({"page_meta": {"total_count": len(records)}, collection: part}, indent=1)
            (root / collection / f"page{i}.json").write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    write_pages(root)
    (root / "seeds.csv").write_text(SEEDS)
    raw = {e: json_pages.read_pages(spark, str(root / c), e) for e, c in json_pages.COLLECTIONS.items()}
    scope = seeds.read_seeds(spark, str(root / "seeds.csv"))
    activity = bronze.project_activities(raw["activity"])
    entities = {
        "activity": activity,
        "molecule": bronze.only_seen(
            bronze.project_molecules(raw["molecule"]), "molecule_chembl_id", activity, "molecule_chembl_id"
        ),
        "target": bronze.enrich_targets(scope, raw["target"]),
        "assay": bronze.project_assays(raw["assay"]),
        "document": bronze.project_documents(raw["document"]),
    }
    for name, df in entities.items():
        assert [f.name for f in contracts.ENTITIES[name]] == df.columns
        assert [f.dataType for f in contracts.ENTITIES[name]] == [f.dataType for f in df.schema]
    results = stages.run_stages(spark, entities, serving_path=str(root / "serving"), index_path=str(root / "index"), gate=False)
    return root, results


def table(spark, name):
    return spark.table(f"gold.{name}")


def test_outcomes(spark, built, rows):
    facts = table(spark, "fact_bioactivity_result")
    got = dict(rows(facts.select("activity_id", gold.Curation().rules.reason())))
    assert got == OUTCOMES


def test_curated_mart(spark, built):
    mart = table(spark, "mart_compound_target_potency")
    assert mart.columns == list(gold.CURATED_COLUMNS)
    assert {r["activity_id"] for r in mart.collect()} == CURATED_IDS
    row = mart.filter("activity_id = 5").first()
    assert (row["compound_name"], row["target_name"], row["standard_value_nm"]) == ("ONE", "Seed two", 5.0)
    assert row["standard_relation"] is None


def test_dimensions(spark, built):
    two = table(spark, "dim_compound").filter("molecule_chembl_id = 'M2'").first()
    assert (two["pref_name"], two["molecular_weight"], two["alogp"], two["hba"]) == (None, 10.5, None, None)
    three = table(spark, "dim_compound").filter("molecule_chembl_id = 'M3'").collect()
    assert [r["pref_name"] for r in three] == ["ALIAS"]
    assert {r["target_name"] for r in table(spark, "dim_target").collect()} == {
        "Alpha kinase", "Seed two", "Gamma kinase",
    }


def test_unknown_keys_survive(spark, built):
    row = table(spark, "fact_bioactivity_result").filter("activity_id = 11").first()
    assert (row["compound_key"], row["target_key"], row["assay_key"], row["document_key"]) == (None,) * 4
    assert row["units_note"] is None and row["standard_value_nm"] == 20.0


def test_target_summary(spark, built):
    got = {r["target_chembl_id"]: r for r in table(spark, "mart_target_activity_summary").collect()}
    one = got["T1"]
    assert (one["total_measurements"], one["total_compounds_tested"], one["total_assays"]) == (5, 2, 2)
    assert (one["curated_measurements"], one["active_compounds"]) == (2, 2)
    assert one["median_potency_nm"] == pytest.approx(16.0) and one["best_pchembl"] == 8.7
    assert got["T2"]["curated_measurements"] == 3 and got["T2"]["median_potency_nm"] == 8.0
    assert set(got) == {"T1", "T2", "T3"}


def test_compound_profile(spark, built):
    got = {r["molecule_chembl_id"]: r for r in table(spark, "mart_compound_profile").collect()}
    assert set(got) == {"M1", "M2", "M3"}
    assert (got["M1"]["targets_tested"], got["M1"]["curated_targets"], got["M1"]["best_pchembl"]) == (3, 3, 8.7)
    assert (got["M3"]["curated_measurements"], got["M3"]["best_potency_nm"]) == (1, 9.0)


def test_assay_quality(spark, built):
    got = {(r["assay_chembl_id"], r["target_chembl_id"]): r for r in table(spark, "mart_assay_quality").collect()}
    a3 = got[("A3", "T2")]
    assert (a3["total_measurements"], a3["curated_measurements"], a3["missing_nm_value"]) == (7, 4, 2)
    assert (a3["missing_pchembl"], a3["ambiguous_relation"], a3["is_low_confidence"]) == (2, 1, False)
    assert got[("A6", "T3")]["is_low_confidence"] is True
    assert got[("A7", "T3")]["is_low_confidence"] is False
    assert ("A9", None) in got


def test_quality_summary(spark, built):
    got = {(r["metric_group"], r["metric"]): r["value"] for r in table(spark, "mart_data_quality_summary").collect()}
    assert got[("volume", "total_measurements")] == 18 and got[("volume", "total_targets")] == 4
    assert got[("completeness", "pct_curated")] == round(100 * 8 / 18, 1)
    assert got[("issue", "low_confidence")] == 1
    assert got[("excluded_by_reason", "low_confidence_score")] == 3
    assert got[("issue", "unconvertible_units")] == 2 and got[("issue", "missing_standard_value")] == 1
    # (M1,T1,A1,IC50) and (M2,T2,A3,Ki) once each, (M2,T2,A3,IC50) once
    assert got[("issue", "duplicate_measurements")] == 3
    excluded = sum(v for (g, _), v in got.items() if g == "excluded_by_reason")
    assert excluded + 8 == 18


def test_checks_pass(built):
    _, results = built
    failed = {(r["table_name"], r["check_name"]) for r in results["build_marts"].filter("status = 'fail'").collect()}
    # the one row of an unknown target and compound has NULL keys, which is no violation;
    # bronze holds one row without an id
    assert failed == {("bronze_activity", "not_null_activity_id")}


def test_failed_checks_stop_the_run(built):
    _, results = built
    with pytest.raises(stages.FailedChecks, match="bronze_activity.not_null_activity_id: 1"):
        stages.checked(results["build_marts"])
    assert stages.checked(results["build_marts"].filter("status <> 'fail'")).count() > 0


def test_checks_follow_the_contract(spark):
    schema = "standard_type string, standard_value_nm double, pchembl_value double, confidence_score int, standard_relation string"
    keys = ", activity_id int, molecule_chembl_id string, target_chembl_id string, assay_chembl_id string"
    mart = spark.createDataFrame([("Inhibition", 3.0, 8.5, 5, "=", 1, "M", "T", "A")], schema + keys)
    status = lambda rules: {r["status"] for r in warehouse_suite({"mart_compound_target_potency": mart}, rules).collect()}
    own = potency_rules(["Inhibition"], 5)
    assert status(own) == {"pass"} and "fail" in status(None)
    assert gold.Curation(rules=own).min_confidence == 5


def test_graph(spark, built, rows):
    assert rows(table(spark, "graph_target_similarity"), "target_a", "target_b", "shared_compounds", "jaccard") == [
        ("T1", "T2", 2, 0.6667), ("T1", "T3", 1, 0.5), ("T2", "T3", 1, 0.3333),
    ]
    edges = table(spark, "graph_compound_target_edge")
    assert rows(edges.filter("molecule_chembl_id = 'M1'"), "target_chembl_id", "best_pchembl") == [
        ("T1", 8.7), ("T2", 8.3), ("T3", 7.51),
    ]
    near = relationships.target_neighbors(table(spark, "graph_target_similarity"), "T2").collect()
    assert [(r["neighbor_chembl_id"], r["shared_compounds"]) for r in near] == [("T1", 2), ("T3", 1)]
    mine = relationships.compound_targets(edges, "M1").collect()
    assert [r["target_chembl_id"] for r in mine] == ["T1", "T2", "T3"]
    top = relationships.most_promiscuous(edges).collect()
    assert [(r["molecule_chembl_id"], r["targets_hit"]) for r in top] == [("M1", 3), ("M2", 2)]


def test_published_and_indexed(spark, built):
    root, results = built
    assert len(results["publish_marts"]) == 12
    copy = spark.read.parquet(str(root / "serving" / "mart_compound_target_potency"))
    assert copy.count() == len(CURATED_IDS)
    evidence = spark.read.parquet(str(root / "index" / "evidence"))
    assert {r["doc_id"] for r in evidence.collect()} == {str(i) for i in CURATED_IDS}
    knowledge = spark.read.parquet(str(root / "index" / "knowledge"))
    counts = {r["doc_type"]: r["count"] for r in knowledge.groupBy("doc_type").count().collect()}
    assert counts == {"target_summary": 3, "target_relationship": 3, "assay": 7, "metric_glossary": 7}
    assert knowledge.select("doc_id").distinct().count() == knowledge.count()
    assert all(len(r["embedding"]) == 384 for r in knowledge.select("embedding").collect())


def test_knowledge_search(spark, built):
    root, _ = built
    knowledge = spark.read.parquet(str(root / "index" / "knowledge"))
    asked = spark.createDataFrame([(1, "Gamma kinase summary"), (2, "logarithm of molar activity")], "query_id int, text string")
    keyword = corpus.search_passages(knowledge, asked, mode="keyword").collect()
    first = {r["query_id"]: r["doc_id"] for r in keyword if r["rank"] == 1}
    assert first == {1: "target:T3", 2: "metric:pChEMBL"}
    assert {r["retrieval"] for r in keyword} == {"keyword"}
    fallback = corpus.search_passages(knowledge, asked, doc_type="metric_glossary", limit=2).collect()
    assert {r["retrieval"] for r in fallback} == {"keyword_fallback"}
    assert {r["doc_type"] for r in fallback} == {"metric_glossary"}
    with pytest.raises(ValueError):
        corpus.search_passages(knowledge, asked, doc_type="no such type")


def test_reports(spark, built):
    mart, profile = table(spark, "mart_compound_target_potency"), table(spark, "mart_compound_profile")
    report = serving.compound_report(profile, mart, " m1 ")
    assert report["profile"].count() == 1
    assert [r["target_chembl_id"] for r in report["best_potency_by_target"].collect()] == ["T1", "T2", "T3"]
    assert [r["pchembl_value"] for r in report["assay_evidence"].collect()] == [8.7, 8.3, 7.51]
    target = serving.target_report(table(spark, "mart_target_activity_summary"), mart, "T2")
    assert [(r["standard_type"], r["curated_rows"], r["missing_pchembl"]) for r in target["curated_breakdown_by_type"].collect()] == [
        ("Ki", 2, 0), ("Kd", 1, 0),
    ]
    shown = serving.explain_rows(table(spark, "fact_bioactivity_result"), "molecule_chembl_id", "M2", limit=3)
    assert [r["activity_id"] for r in shown.collect()] == [2, 3, 13]
    assert tuple(serving.explained_totals(shown).first()) == (3, 1, 2)
    quality = table(spark, "mart_data_quality_summary")
    assert serving.kpi(quality, "total_targets").first()["value"] == 4
    board = serving.kpi_board(quality, ["total_targets", "pct_curated"]).first()
    assert board["total_targets"] == 4
    reasons = [r["value"] for r in serving.excluded_by_reason(quality).collect()]
    assert reasons == sorted(reasons, reverse=True)


def test_governed_sql_over_published_tables(spark, built):
    lake.publish(spark, "gold", catalog=True)
    out = governed_sql(spark, "select target_name from marts.mart_target_activity_summary order by 1")
    assert [r[0] for r in out.rows.collect()] == ["Alpha kinase", "Gamma kinase", "Seed two"]
    assert "dim_target" in lake.bare_views(spark)
    assert governed_sql(spark, "select * from dim_target limit 2").rows.count() == 2


def test_catalog(spark, built, rows):
    tables = catalog.database_tables(spark, "gold")
    overview = catalog.describe_tables(spark, tables, "dim_document")
    assert [r["column_name"] for r in overview.orderBy("ordinal").collect()] == [
        "document_key", "document_chembl_id", "pubmed_id", "journal", "year",
    ]
    assert catalog.describe_tables(spark, tables, "nope").count() == 0
    assert dict(rows(lake.row_counts({"d": tables["dim_document"]}))) == {"d": 3}
    views = lake.layer_views(spark)
    assert "bronze_activity" in views and "gold_dim_target" in views
    assert serving.register_models(tables) == list(serving.MODELS)
    assert spark.sql("select count(*) from `Compound-Target Edges`").first()[0] == 6


def test_unknown_stage_is_refused(spark):
    with pytest.raises(ValueError):
        stages.run_stages(spark, {}, stages=["nope"])


def test_record_filters(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "k string, v string")
    assert json_pages.filter_records(df, {"k": "a", "limit": "1"}).count() == 1
    assert json_pages.filter_records(df, {"k__in": "a, b ,c", "format": "json"}).count() == 2
    assert json_pages.filter_records(df, {}).count() == 3


def test_seed_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b,c,d,e\nT1,G1,only three\n")
    with pytest.raises(contracts.ContractError):
        seeds.read_seeds(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(contracts.ContractError):
        seeds.read_seeds(spark, str(tmp_path / "empty.csv"))
    assert seeds.default_seeds(spark).count() == 5


def test_contract(spark):
    df = spark.createDataFrame([("1", "x", "D", "J", "2001")], "pubmed_id string, more string, document_chembl_id string, journal string, year string")
    fixed = contracts.enforce_contract(df, contracts.DOCUMENT)
    assert tuple(fixed.first()) == ("D", 1, "J", 2001)
    with pytest.raises(contracts.ContractError, match="year"):
        contracts.enforce_contract(df.drop("year"), contracts.DOCUMENT)
    assert contracts.contract_ddl(contracts.DOCUMENT).startswith("document_chembl_id string, pubmed_id int")


def test_jdbc_options():
    config = jdbc.JdbcConfig("jdbc:db://host/x", "me", "secret")
    options = jdbc.jdbc_options(config, " SELECT 1; ", jdbc.Split("id", 1, 100, 8))
    assert options["dbtable"] == "(SELECT 1) AS extract"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "8")
    assert "partitionColumn" not in jdbc.jdbc_options(config, "SELECT 1")


def test_staging_can_deduplicate(spark):
    line = (1, "M", "T", "A", "D", " IC50 ", "", float("nan"), "nM", 1.0, None, 7.0, None, None)
    df = spark.createDataFrame([line, line], contracts.ACTIVITY)
    assert silver.stage_activity(df).count() == 2
    once = silver.stage_activity(df, unique_ids=True).collect()
    assert len(once) == 1
    assert (once[0]["standard_type"], once[0]["standard_relation"], once[0]["standard_value"]) == ("IC50", None, None)


def test_snapshot_counts_while_writing(spark):
    lake.create_layers(spark)
    assert lake.write_snapshot(spark.range(7), "bronze.counted", count=True) == 7
    assert lake.write_snapshot(spark.range(3).withColumnRenamed("id", "other"), "bronze.counted") is None
    assert spark.table("bronze.counted").columns == ["other"] and spark.table("bronze.counted").count() == 3
