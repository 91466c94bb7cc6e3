"""The check suite leaves no shuffle files, and its turns change no result."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from gaugeworks.entries import checks as suite
from gaugeworks.operators import checks
from gaugeworks.operators.dedup import distinct_counts
from gaugeworks.session import scratch, shuffles_removed

PLACES = {
    "region": [(0, "R")],
    "nation": [(i, f"N{i}", 0) for i in range(3)],
    "customer": [(i, f"C{i}", i % 3, 1.0, "M") for i in range(5)],
    "supplier": [(i, f"S{i}", i % 3, 1.0) for i in range(7)],
    "part": [(i, f"P{i}", "B", "T", i, 100.0 + i) for i in range(11)],
}


@pytest.fixture
def tables(spark, tmp_path):
    from datetime import datetime

    from gaugeworks.entries.warehouse import TABLES

    day = datetime(2020, 1, 1)
    rows = dict(PLACES)
    rows["orders"] = [(i, i % 5, "O", 1.0, day, f"{i % 5 + 1}-P") for i in range(40)]
    # some line items twice, some without a known part, supplier or order
    lines = [
        (i % 45, i % 13, i % 8, i % 7 + 1, float(i % 50 + 1), 100.0 + i, i % 11 / 100, i % 9 / 100, "ANR"[i % 3], "OF"[i % 2], day)
        for i in range(300)
    ]
    rows["lineitem"] = lines + lines[:20] + [(None, None, None, 1, 5.0, 9.0, 0.1, 0.1, "A", "F", day)]
    for name, made in rows.items():
        spark.createDataFrame(made, TABLES[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_suite_leaves_no_shuffle_files_and_turns_change_nothing(spark, tables, monkeypatch):
    run = entry.queries()["check_suite"]
    got = []
    for lines in (500_000, 50):
        monkeypatch.setattr(suite, "LINES_A_TURN", lines)
        before = shuffle_files(spark)
        with scratch(spark):
            got.append(sorted(tuple(r) for r in run(spark, tables).collect()))
        assert not shuffle_files(spark) - before
    assert got[0] == got[1]
    failures = {(t, c): n for t, c, _, n, _ in got[0]}
    assert failures["stg_activity", "unique_activity_id"] == failures["fact_bioactivity_result", "unique_activity_id"] == 20
    assert failures["fact_bioactivity_result", "reasons_reconcile"] == 0


def test_checks_one_by_one_give_the_same_rows(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    given = [("t", df, [checks.not_null("v")], [checks.unique(df, "k")]), ("u", df, [checks.not_null("k", checks.WARN)], [])]
    assert rows(checks.run_suite(given, one_by_one=True)) == rows(checks.run_suite(given))
    assert checks.run_suite(given, one_by_one=True).schema.simpleString() == checks.run_suite(given).schema.simpleString()


def test_counts_made_apart_are_the_same(spark, rows):
    df = spark.createDataFrame([(1, 5, None), (1, 5, 2), (None, 1, 1), (2, None, None)], "k int, a int, b int")
    wanted = rows(distinct_counts(df, "k", {"x": "a", "y": "b"}))
    before = shuffle_files(spark)
    with shuffles_removed(spark):
        assert rows(distinct_counts(df, "k", {"x": "a", "y": "b"}, apart=True)) == wanted
    assert not shuffle_files(spark) - before
    assert spark.range(3).agg(F.sum("id")).first()[0] == 3
