import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import lake, versions


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_tables_switch_together(spark, root):
    assert versions.versions(spark, root) == []
    assert versions.commit(spark, root, {"a": spark.range(3), "b": spark.range(5)}) == 1
    assert versions.commit(spark, root, {"a": spark.range(1).withColumn("more", F.lit("x"))}) == 2
    assert versions.read(spark, root, "a").columns == ["id", "more"]
    assert ids(versions.read(spark, root, "b")) == [0, 1, 2, 3, 4]
    assert ids(versions.read(spark, root, "a", 1)) == [0, 1, 2]


def test_a_table_can_be_computed_from_the_version_it_replaces(spark, root):
    versions.commit(spark, root, {"a": spark.range(3)})
    old = versions.read(spark, root, "a")
    versions.commit(spark, root, {"a": old.union(old.withColumn("id", F.col("id") + 10))})
    assert ids(versions.read(spark, root, "a")) == [0, 1, 2, 10, 11, 12]


def test_a_write_that_dies_leaves_the_old_rows(spark, root):
    versions.commit(spark, root, {"a": spark.range(3), "b": spark.range(2)})
    # some tasks have written their file when the one with row 900 fails
    broken = spark.range(0, 1000, 1, 8).select(
        F.when(F.col("id") == 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")
    )
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, root, {"b": spark.range(7), "a": broken})
    assert versions.versions(spark, root) == [1]
    assert ids(versions.read(spark, root, "a")) == [0, 1, 2] and ids(versions.read(spark, root, "b")) == [0, 1]
    removed = versions.expire(spark, root, min_age_seconds=0)
    assert [f.split("/")[1] for f in removed] == ["a", "b"]
    assert ids(versions.read(spark, root, "b")) == [0, 1]


def test_a_failed_check_keeps_the_old_version(spark, root):
    def not_empty(df):
        if df.isEmpty():
            raise ValueError("empty")

    versions.commit(spark, root, {"a": spark.range(3)}, {"a": [not_empty]})
    with pytest.raises(ValueError, match="empty"):
        versions.commit(spark, root, {"a": spark.range(0)}, {"a": [not_empty]})
    assert ids(versions.read(spark, root, "a")) == [0, 1, 2]
    with pytest.raises(ValueError, match="not written"):
        versions.commit(spark, root, {"a": spark.range(3)}, {"b": [not_empty]})


def test_the_second_of_two_writers_is_told(spark, root):
    versions.commit(spark, root, {"a": spark.range(3)})
    versions.commit(spark, root, {"a": spark.range(4)}, base=1)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"a": spark.range(5)}, base=1)
    assert ids(versions.read(spark, root, "a")) == [0, 1, 2, 3]


def test_old_versions_expire(spark, root):
    for n in (1, 2, 3):
        versions.commit(spark, root, {"a": spark.range(n)}, partition_by={"a": []})
    assert versions.expire(spark, root) == []
    assert len(versions.expire(spark, root, keep=2, min_age_seconds=0)) == 1
    assert versions.versions(spark, root) == [2, 3]
    with pytest.raises(LookupError, match="no version 1"):
        versions.read(spark, root, "a", 1)
    with pytest.raises(LookupError, match="no table b"):
        versions.read(spark, root, "b")
    with pytest.raises(ValueError, match="at least one"):
        versions.expire(spark, root, keep=0)


def test_empty_and_null_rows_and_partitions(spark, root):
    rows = spark.createDataFrame([(None, "x"), (1, None), (1, None)], "id long, kind string")
    versions.commit(spark, root, {"a": rows, "none": rows.limit(0)}, partition_by={"a": ["kind"]})
    assert versions.read(spark, root, "a").count() == 3
    assert versions.read(spark, root, "none").columns == ["id", "kind"]


def test_publish_switches_once(spark, root):
    spark.sql("create database if not exists swaps")
    lake.write_snapshot(spark.range(2), "swaps.one")
    lake.write_snapshot(spark.range(3), "swaps.two")
    assert lake.publish(spark, "swaps", versioned=root) == ["one", "two"]
    assert versions.versions(spark, root) == [1]
    assert ids(versions.read(spark, root, "two")) == [0, 1, 2]
    spark.sql("drop database swaps cascade")
