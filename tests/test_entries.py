"""Every registered query against its SQL twin, on the smallest data set."""

import os

import duckdb
import pytest

from gaugeworks.entries import ORACLES, QUERIES
from gaugeworks.entries.warehouse import TABLES
from tools.compare import compare

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, *_ = compare(spark, con, SMALL, name)
    assert verdict == "ok"


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
