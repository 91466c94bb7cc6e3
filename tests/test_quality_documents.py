"""The data-quality summary joins documents to nothing but their ids."""

import os

import pytest

from gaugeworks.entries.warehouse import Warehouse
from gaugeworks.plans import gold

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not here")


@pytest.mark.parametrize("replicates", [False, True])
def test_documents_may_be_counted_apart(spark, rows, replicates):
    w = Warehouse(spark, SMALL, replicates=replicates)
    whole = gold.attach(w.stg_activity, w.dims, ("assay",))
    want = rows(gold.data_quality_summary(whole))
    bare = whole.drop("document_chembl_id")
    assert rows(gold.data_quality_summary(bare, documents=whole.select("document_chembl_id"))) == want
    assert rows(w.dq) == want
