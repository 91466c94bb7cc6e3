"""Schema overview of the serving tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

OVERVIEW = "table_name string, column_name string, ordinal int, data_type string, column_count int"


def describe_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame], table: str | None = None
) -> DataFrame:
    """One row per column, ordered by table and position; empty for an unknown table.

    Works on schemas only: no data is read.
    """
    rows = [
        (name, field.name, at, field.dataType.simpleString(), len(df.columns))
        for name, df in sorted(tables.items())
        if table is None or name == table
        for at, field in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(rows, OVERVIEW)


def database_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {
        t.name: spark.table(f"{database}.{t.name}")
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
    }
