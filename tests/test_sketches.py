import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sketches
from gaugeworks.plans import sketch_marts

SUMMARY = sketches.Summary(
    ("k",), "n", largest={"top": "v"}, least={"low": "v"}, distinct={"kinds": "id"}, quantiles={"median": "v"}
)


def measured(spark, n, seed, key="a"):
    """Skewed values with ties; ids repeat."""
    rng = np.random.default_rng(seed)
    rows = [(key, int(i), float(round(v, 2))) for i, v in zip(rng.integers(0, n // 3, n), rng.lognormal(0, 2, n))]
    return spark.createDataFrame(rows, "k string, id long, v double"), rows


def test_batches_merge_into_the_whole(spark, tmp_path):
    one, rows_one = measured(spark, 6000, 1)
    two, rows_two = measured(spark, 9000, 2)
    path = str(tmp_path / "states")
    sketches.write_batch(one, SUMMARY, path, "one")
    sketches.write_batch(two, SUMMARY, path, "two")
    (got,) = sketches.read_estimates(spark, SUMMARY, path).collect()
    rows = rows_one + rows_two
    values = np.array([r[2] for r in rows])
    kinds = len({r[1] for r in rows})
    assert (got["n"], got["top"], got["low"]) == (len(rows), values.max(), values.min())
    assert abs(got["kinds"] - kinds) <= 0.04 * kinds
    assert got["median"] in values
    assert np.mean(values < got["median"]) <= 0.52 and np.mean(values <= got["median"]) >= 0.48
    whole = sketches.estimate(sketches.summarise(one.union(two), SUMMARY), SUMMARY).first()
    assert whole["kinds"] == got["kinds"]


def test_a_batch_replaces_only_itself(spark, tmp_path):
    one, rows_one = measured(spark, 300, 1)
    two, rows_two = measured(spark, 600, 2, "b")
    path = str(tmp_path / "states")
    for df, batch in ((one, "one"), (two, "two"), (two, "two"), (one.limit(7), "one")):
        sketches.write_batch(df, SUMMARY, path, batch)
    got = {r["k"]: r["n"] for r in sketches.read_estimates(spark, SUMMARY, path).collect()}
    assert got == {"a": 7, "b": 600}


def test_quantiles_of_other_ranks(spark):
    df, rows = measured(spark, 20000, 3)
    values = np.array([r[2] for r in rows])
    states = sketches.summarise(df, SUMMARY)
    for q in (0.0, 0.1, 0.9, 1.0):
        got = sketches.estimate(states, SUMMARY, q).first()["median"]
        assert np.mean(values < got) <= q + 0.02 and np.mean(values <= got) >= q - 0.02


def test_nulls_nan_and_empty(spark, tmp_path):
    rows = [("x", None, None), ("x", None, float("nan")), (None, 1, 2.0), (None, 1, None), ("y", 3, float("nan")), ("y", 4, 5.0)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    path = str(tmp_path / "states")
    sketches.write_batch(df, SUMMARY, path, "rows")
    sketches.write_batch(df.limit(0), SUMMARY, path, "none")
    got = {r["k"]: (r["n"], r["kinds"], r["median"]) for r in sketches.read_estimates(spark, SUMMARY, path).collect()}
    assert got == {"x": (2, 0, None), None: (2, 1, 2.0), "y": (2, 2, 5.0)}
    assert sketches.estimate(sketches.merge(sketches.summarise(df.limit(0), SUMMARY), SUMMARY), SUMMARY).count() == 0


def test_names(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        sketches.Summary(("k",), "n", largest={"k": "v"})
    for name in ("", "a/b", "_hidden", ".hidden"):
        with pytest.raises(ValueError, match="batch"):
            sketches.write_batch(spark.range(1), SUMMARY, str(tmp_path), name)


def test_a_second_batch_reads_nothing_of_the_first(spark, tmp_path):
    """The states of a batch are all that is left of it."""
    schema = """activity_id long, molecule_chembl_id string, target_chembl_id string, assay_chembl_id string,
      standard_value_nm double, pchembl_value double"""
    row = lambda i, m, t, v: (i, m, t, f"A{i}", v, 9.0 - v)
    first = spark.createDataFrame([row(1, "m1", "t1", 1.0), row(2, "m2", "t1", 3.0)], schema)
    second = spark.createDataFrame([row(3, "m2", "t1", 2.0), row(4, "m1", "t2", 4.0)], schema)
    path = str(tmp_path / "marts")
    gone = str(tmp_path / "first")
    first.write.parquet(gone)
    stored = spark.read.parquet(gone)
    sketch_marts.add_batch(stored, path, "1", stored)
    spark.range(1).withColumn("x", F.lit(1)).write.mode("overwrite").parquet(gone)
    sketch_marts.add_batch(second, path, "2", second)
    targets = spark.createDataFrame([("t1", "T1", "o"), ("t2", "T2", "o"), ("t3", "T3", "o")], "target_chembl_id string, target_name string, organism string")
    got = {r["target_chembl_id"]: r for r in sketch_marts.target_summary_merged(spark, path, targets).collect()}
    assert (got["t1"]["total_measurements"], got["t1"]["total_compounds_tested"], got["t1"]["median_potency_nm"]) == (3, 2, 2.0)
    assert (got["t2"]["curated_measurements"], got["t2"]["best_pchembl"]) == (1, 5.0)
    assert (got["t3"]["total_measurements"], got["t3"]["active_compounds"], got["t3"]["median_pchembl"]) == (0, 0, None)
    compounds = spark.createDataFrame([("m2", "M2")], "molecule_chembl_id string, pref_name string")
    (profile,) = sketch_marts.compound_profile_merged(spark, path, compounds).collect()
    assert (profile["total_measurements"], profile["targets_tested"], profile["best_potency_nm"]) == (2, 1, 2.0)


@pytest.mark.parametrize("name", ["target_summary_merged", "compound_profile_merged"])
def test_merged_marts_grade_line_items_once(spark, name):
    """What is stored feeds states and exact marts alike: the result reads no line item again."""
    import contextlib
    import io

    from gaugeworks.entries import QUERIES

    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "lineitem.parquet" not in plan.getvalue()
