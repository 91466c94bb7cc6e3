"""What the scoped extracts carry through their joins."""

import os

import pytest

from gaugeworks.entries import QUERIES
from gaugeworks.entries.bronze import Source
from gaugeworks.entries.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not here")


def test_texts_of_activities_are_made_after_the_last_join(spark):
    plan = QUERIES["activity_extract"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Join")
    assert plan.count("concat_ws") == 1


def test_measured_columns_need_the_ids_only(spark):
    source = Source(spark, SMALL)
    assert "activity_id" not in source.activities.columns
    assert {"assay_id", "molregno", "doc_id"} <= set(source.activities.columns)


def test_measurements_meet_orders_and_assays_after_one_shuffle(spark):
    """Where the order is the assay, documents and assays are joined on one column."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Warehouse(spark, SMALL).curated._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("hashpartitioning(assay_chembl_id") == 1
    # the other shuffle by order is the one that spreads a small file
    assert plan.count("hashpartitioning(l_orderkey") == plan.count("REPARTITION_BY_NUM") <= 1
