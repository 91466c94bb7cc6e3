"""Distinct counts without copies of rows, and the units of line items."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.entries.warehouse import raw_units
from gaugeworks.operators.dedup import distinct_counts
from gaugeworks.plans import gold
from gaugeworks.session import configure

FACTS = "activity_id string, target_chembl_id int, molecule_chembl_id long, assay_chembl_id long, standard_value_nm double, pchembl_value double"


def made_facts(n=400, seed=5):
    pick = random.Random(seed)
    rows = [
        (pick.choice([None, f"a{pick.randrange(200)}"]), pick.choice([None, 1, 2, 3]), pick.choice([None, *range(20)]), pick.randrange(50), 1.0 + i, 5.0)
        for i in range(n)
    ]
    return [*rows, (None, 4, None, None, 1.0, None)]


def distinct(rows, target, column):
    return len({r[column] for r in rows if r[1] == target and r[column] is not None})


def test_equals_loop(spark):
    facts = made_facts()
    found = distinct_counts(spark.createDataFrame(facts, FACTS), "target_chembl_id", {"ids": "activity_id", "assays": "assay_chembl_id"})
    got = {r["target_chembl_id"]: (r["ids"], r["assays"]) for r in found.collect()}
    assert got == {t: (distinct(facts, t, 0), distinct(facts, t, 3)) for t in (1, 2, 3)}


@pytest.mark.parametrize("unique_ids", [False, True])
def test_target_summary_counts_without_copies_of_rows(spark, unique_ids):
    facts = made_facts()
    df = spark.createDataFrame(facts, FACTS)
    targets = spark.createDataFrame([(t, f"t{t}", None) for t in (1, 2, 3, 4, 5)], "target_chembl_id int, target_name string, organism string")
    summary = gold.target_activity_summary(df, df, targets, gold.Curation(unique_ids=unique_ids))
    assert "Expand" not in summary._jdf.queryExecution().optimizedPlan().toString()
    got = {r["target_chembl_id"]: r for r in summary.collect()}
    for t in (1, 2, 3, 4, 5):
        ids = sum(r[1] == t and r[0] is not None for r in facts) if unique_ids else distinct(facts, t, 0)
        assert (got[t]["total_measurements"], got[t]["curated_measurements"]) == (ids, ids)
        assert got[t]["total_compounds_tested"] == got[t]["active_compounds"] == distinct(facts, t, 2)
        assert got[t]["total_assays"] == distinct(facts, t, 3)


def test_units_by_place(spark):
    lines = [None, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    df = spark.createDataFrame([(n, s) for n in lines for s in (1, 2, None)], "l_linenumber int, l_suppkey long")
    first = {1: "nM", 2: " uM ", 3: "mM", 4: "pM", 5: "%", 6: ""}
    for r in df.withColumn("unit", raw_units()).collect():
        last = "nM" if r["l_linenumber"] == 7 and r["l_suppkey"] == 2 else None
        assert r["unit"] == first.get(r["l_linenumber"], last)


def test_methods_that_the_jvm_would_interpret_are_not_made(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
