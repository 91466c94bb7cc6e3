"""Results are as large as asked for; broken pages and missing sinks are errors."""

import json

import pytest
from pyspark.sql import types as T

from gaugeworks.operators.search import asked_for, terms_aggregation
from gaugeworks.plans.corpus import assay_passages
from gaugeworks.session import materialize, scratch, shared_folder
from gaugeworks.sources.jdbc import column_types
from gaugeworks.sources.json_pages import COLLECTIONS, read_pages
from gaugeworks.sources.lake import publish


def test_limits_are_honoured_or_refused(spark):
    assert asked_for(None, 5) == 5 and asked_for(500, 5) == 500
    with pytest.raises(ValueError):
        asked_for(0, 5)
    values = spark.range(40).selectExpr("cast(id % 25 as string) as v")
    assert terms_aggregation(values, "v").count() == 25
    assert terms_aggregation(values, "v", 3).count() == 3


def test_every_assay_has_a_passage(spark):
    quality = spark.range(4100).selectExpr(
        "cast(id as string) as assay_chembl_id", "'T' as target_chembl_id", "'t' as target_name", "'d' as assay_description",
        "'B' as assay_type", "9 as confidence_score", "id as total_measurements", "id as curated_measurements",
    )
    assert assay_passages(quality).count() == 4100
    assert assay_passages(quality, 7).count() == 7


@pytest.mark.parametrize("page", ['{"activities": [{"activity_id": "1"', '{"other": []}'])
def test_broken_pages_fail(spark, tmp_path, page):
    entity = next(e for e, c in COLLECTIONS.items() if c == "activities")
    (tmp_path / "good.json").write_text(json.dumps({"activities": [{"activity_id": "1"}]}))
    assert read_pages(spark, str(tmp_path), entity).count() == 1
    (tmp_path / "bad.json").write_text(page)
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|no collection"):
        read_pages(spark, str(tmp_path), entity).collect()


def test_publish_needs_a_sink(spark):
    with pytest.raises(ValueError, match="publish needs"):
        publish(spark, "default")


def test_string_columns_are_left_to_the_dialect():
    schema = T.StructType.fromDDL("my_string string, n int, x decimal(10,2)")
    assert T.StructType.fromDDL(column_types(schema)) == T.StructType.fromDDL("n int, x decimal(10,2)")


def test_scratch_is_removed(spark):
    import glob

    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/gaugeworks-*"))
    with scratch(spark):
        assert materialize(spark.range(3)).count() == 3
        assert set(glob.glob(f"{folder}/gaugeworks-*")) > before
    assert set(glob.glob(f"{folder}/gaugeworks-*")) == before
