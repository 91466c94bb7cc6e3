"""Marts of one warehouse share the curated rows."""

import os

import pytest

from gaugeworks.entries import QUERIES
from gaugeworks.entries.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not here")


def test_models_choose_curated_rows_for_one_mart_only(spark):
    """The wide curated mart chooses its rows itself; the others read what is written once."""
    plan = QUERIES["semantic_models"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number() windowspecdefinition(molecule_chembl_id") == 1


@pytest.mark.parametrize("mart", ["profile", "similarity", "edges", "summary"])
def test_shared_marts_are_the_same(spark, rows, mart):
    apart, shared = (Warehouse(spark, SMALL, replicates=True, shared=s) for s in (False, True))
    assert rows(getattr(shared, mart)) == rows(getattr(apart, mart))
