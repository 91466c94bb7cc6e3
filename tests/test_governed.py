import threading
import time

import pytest

from gaugeworks.operators.audit import audit_sql_log
from gaugeworks.operators.governed import (
    DEFAULT_ROWS,
    MAX_ROWS,
    OPEN_TABLES,
    GovernanceError,
    Policy,
    check_sql,
    governed_rows,
    governed_sql,
)

REFUSED = [
    # tables that are not open
    "select hbd from silver.stg_compound",
    "select count(*) from bronze.activity",
    "select units_note from gold.fact_bioactivity_result",
    "select column_name from information_schema.columns where table_name = 'dim_assay'",
    "select relname from pg_catalog.pg_class",
    # statements that write rows
    "insert overwrite dim_document select * from dim_document",
    "merge into dim_assay using dim_target on true when matched then delete",
    "update dim_assay set assay_type = null",
    "delete from dim_compound where hba > 3",
    # statements that change definitions or rights
    "create view v as select assay_type from dim_assay",
    "alter view dim_document rename to papers",
    "drop view if exists mart_assay_quality",
    "revoke all on dim_compound from analyst",
    # more or less than one statement
    "select year from dim_document; select journal from dim_document",
    "-- nothing but a remark",
    "\n\t",
]
# what a check of the text would let through
LEAKS = [
    "SELECT * FROM dim_target, raw.secret",
    "SELECT * FROM dim_target WHERE id IN (SELECT id FROM raw.secret)",
    "SELECT (SELECT max(id) FROM raw.secret) FROM dim_target",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT * FROM raw.dim_target",
    "SELECT * FROM other.marts.dim_target",
    "SELECT * FROM (WITH x AS (SELECT 1 AS a) SELECT * FROM x) y, x",
    "SELECT * FROM parquet.`/tmp`",
    "SELECT * FROM range(5)",
    "SELECT * FROM IDENTIFIER('raw.secret')",
    "SELECT java_method('java.lang.System', 'exit', 0) FROM dim_target",
    "SELECT * FROM dim_target t, LATERAL (SELECT * FROM raw.secret) s",
    "SELECT EXISTS(SELECT 1 FROM raw.secret) FROM dim_assay",
    "SET a = 1",
    "EXPLAIN SELECT 1",
    "SHOW TABLES",
    "CACHE TABLE dim_target",
    "SELECT TRANSFORM(id) USING 'cat' FROM dim_target",
]


@pytest.mark.parametrize("sql", REFUSED + LEAKS)
def test_refused(spark, sql):
    with pytest.raises(GovernanceError):
        check_sql(spark, sql)


@pytest.mark.parametrize(
    "sql, tables, limit",
    [
        ("SELECT * FROM mart_compound_target_potency", {"mart_compound_target_potency"}, DEFAULT_ROWS),
        ("SELECT id FROM marts.mart_target_activity_summary", {"mart_target_activity_summary"}, DEFAULT_ROWS),
        ("WITH t AS (SELECT * FROM dim_target) SELECT id FROM t LIMIT 3", {"dim_target"}, 3),
        ("SELECT * FROM dim_target LIMIT 2 + 3", {"dim_target"}, MAX_ROWS),
        ("SELECT * FROM mart_compound_profile LIMIT 100000", {"mart_compound_profile"}, MAX_ROWS),
        ("SELECT a.id FROM dim_assay a JOIN dim_target d ON a.id = d.id", {"dim_assay", "dim_target"}, DEFAULT_ROWS),
        ("SELECT 1 AS x FROM dim_target -- DROP TABLE dim_target", {"dim_target"}, DEFAULT_ROWS),
        ("SELECT * FROM dim_target WHERE comment = 'set'", {"dim_target"}, DEFAULT_ROWS),
        ("SELECT * FROM graph_target_similarity;", {"graph_target_similarity"}, DEFAULT_ROWS),
        ("WITH a AS (SELECT * FROM dim_assay), b AS (SELECT * FROM a) SELECT * FROM b", {"dim_assay"}, DEFAULT_ROWS),
    ],
)
def test_accepted(spark, sql, tables, limit):
    found, bound = check_sql(spark, sql)
    assert set(found) == tables and bound == limit


def test_rows_are_bounded(spark):
    spark.range(1000).createOrReplaceTempView("dim_target")
    count = lambda sql: governed_sql(spark, sql).rows.count()
    assert count("SELECT * FROM dim_target") == DEFAULT_ROWS
    assert count("SELECT * FROM dim_target LIMIT 7") == 7
    assert count("SELECT * FROM dim_target LIMIT 900") == MAX_ROWS
    # an inner limit is the statement's own business
    assert count("SELECT * FROM (SELECT * FROM dim_target LIMIT 5) LIMIT 50") == 5
    small = Policy(tables=["dim_target"], default_rows=2, max_rows=4)
    assert governed_sql(spark, "SELECT * FROM dim_target", small).rows.count() == 2
    assert governed_sql(spark, "SELECT * FROM dim_target LIMIT 9", small).rows.count() == 4


def test_joins_need_an_equality(spark):
    for name in ("dim_target", "dim_assay", "dim_document"):
        spark.range(30).createOrReplaceTempView(name)
    for sql in (
        "SELECT a.id FROM dim_target a, dim_assay b, dim_document c",
        "SELECT a.id FROM dim_target a CROSS JOIN dim_assay b",
        "SELECT a.id FROM dim_target a JOIN dim_assay b ON a.id < b.id",
        "SELECT id FROM dim_target WHERE id IN (SELECT max(a.id) FROM dim_assay a, dim_document b)",
    ):
        with pytest.raises(GovernanceError):
            governed_sql(spark, sql)
    linked = "SELECT a.id FROM dim_target a, dim_assay b WHERE a.id = b.id"
    assert governed_sql(spark, linked).rows.count() == 30
    one_row = "SELECT a.id, m FROM dim_target a, (SELECT max(id) AS m FROM dim_assay) b"
    assert governed_sql(spark, one_row).rows.count() == 30


def test_log_audit(spark):
    statements = [
        *[(s, "rejected") for s in REFUSED],
        ("SELECT pg_read_file('/etc/hosts')", "rejected"),
        ("SELECT * FROM mart_compound_target_potency", "accepted"),
        ("SELECT * FROM marts.mart_compound_profile LIMIT 100000", "accepted"),
        ("WITH t AS (SELECT * FROM dim_target) SELECT * FROM t", "accepted"),
        ("SELECT 1 AS x FROM dim_target -- DROP TABLE dim_target", "accepted"),
        (None, "rejected"),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(statements)], "i int, s string")
    got = {r["i"]: r for r in audit_sql_log(df, "s").collect()}
    assert [got[i]["verdict"] for i in range(len(statements))] == [v for _, v in statements]
    capped = next(r for r in got.values() if r["s"] and r["s"].endswith("100000"))
    assert capped["row_limit"] == MAX_ROWS and capped["governed_sql"].endswith(f"LIMIT {MAX_ROWS}")
    plain = next(r for r in got.values() if r["s"] == "SELECT * FROM mart_compound_target_potency")
    assert plain["governed_sql"].endswith(f"LIMIT {DEFAULT_ROWS}")
    assert plain["referenced_tables"] == "mart_compound_target_potency"


def test_open_tables_leave_the_fact_out():
    assert "fact_bioactivity_result" not in OPEN_TABLES


def test_a_slow_statement_is_stopped_and_others_are_not(spark):
    spark.range(10**13).createOrReplaceTempView("slow_numbers")
    spark.range(5).createOrReplaceTempView("few_numbers")
    policy = Policy(tables=("slow_numbers", "few_numbers"), max_seconds=2)
    other = []
    work = threading.Thread(target=lambda: other.append(spark.range(10**8).selectExpr("sum(hash(id))").collect()))
    work.start()
    begun = time.monotonic()
    with pytest.raises(GovernanceError, match="stopped after 2 seconds"):
        governed_rows(spark, "select sum(hash(id)) from slow_numbers", policy)
    assert time.monotonic() - begun < 30
    assert [r.id for r in governed_rows(spark, "select id from few_numbers order by id", Policy(tables=("few_numbers",), max_seconds=60))] == [0, 1, 2, 3, 4]
    work.join()
    assert len(other) == 1 and not spark.sparkContext.getJobTags()


def test_a_failing_statement_keeps_its_own_error(spark):
    spark.range(3).createOrReplaceTempView("few_numbers")
    with pytest.raises(Exception, match="own words") as raised:
        governed_rows(spark, "select raise_error('own words') from few_numbers", Policy(tables=("few_numbers",), max_seconds=60))
    assert not isinstance(raised.value, GovernanceError)


def test_a_temporary_view_does_not_hide_a_serving_table(spark):
    spark.sql("create schema if not exists shadowed")
    spark.range(2).write.mode("overwrite").saveAsTable("shadowed.mart_shadow")
    policy = Policy(tables=("mart_shadow",), schema="shadowed", max_seconds=60)
    spark.range(7).createOrReplaceTempView("mart_shadow")
    try:
        with pytest.raises(GovernanceError, match="hides"):
            governed_sql(spark, "select count(*) from mart_shadow", policy)
        assert governed_rows(spark, "select count(*) from shadowed.mart_shadow", policy)[0][0] == 2
    finally:
        spark.catalog.dropTempView("mart_shadow")
