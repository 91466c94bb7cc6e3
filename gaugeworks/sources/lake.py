"""Lake tables and directories: contract-checked reads, replace writes, publishing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.contracts import enforce_contract
from gaugeworks.sources import versions
from gaugeworks.sources.jdbc import JdbcConfig, replace_table

# The layers of the lake.
LAYERS = ("bronze", "silver", "gold")
SERVING_SCHEMA = "marts"


def create_layers(spark: SparkSession, layers: Sequence[str] = LAYERS) -> None:
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, name: str = "") -> DataFrame:
    return enforce_contract(spark.read.parquet(path), schema, name or path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a directory; one file per task, no funnel through a single writer."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_snapshot(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    count: bool = False,
) -> int | None:
    """Create or replace a table, contents and schema alike.

    The row count, when wanted, is observed during the write instead of by
    reading the table again.
    """
    seen = Observation("rows") if count else None
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if len(table.split(".")) > 2:
        # catalog.database.table: a v2 catalog, which can swap the snapshot atomically
        writer = df.writeTo(table).using(fmt)
        if partition_by:
            writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
        writer.createOrReplace()
    else:
        writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return None if seen is None else int(seen.get["n"])


def publish(
    spark: SparkSession,
    database: str = "gold",
    jdbc: JdbcConfig | None = None,
    path: str | None = None,
    schema: str = SERVING_SCHEMA,
    catalog: bool = False,
    versioned: str | None = None,
) -> list[str]:
    """Copy every table of a database to the serving store.

    The store is a JDBC schema, a parquet root, a database of this catalog, a versioned root
    (all tables switch together, once all are written), or several of them.
    """
    if jdbc is None and path is None and not catalog and versioned is None:
        raise ValueError("publish needs a JDBC store, a path, a catalog database or a versioned root")
    if catalog:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    for name in names:
        df = spark.table(f"{database}.{name}")
        if jdbc is not None:
            replace_table(df, jdbc, f"{schema}.{name}")
        if path is not None:
            write_parquet(df, f"{path}/{name}")
        if catalog:
            write_snapshot(df, f"{schema}.{name}")
    if versioned is not None:
        versions.commit(spark, versioned, {name: spark.table(f"{database}.{name}") for name in names})
    return names


def bare_views(spark: SparkSession, database: str = SERVING_SCHEMA) -> list[str]:
    """A temp view of the same name for every table of a database, for unqualified SQL."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    for name in names:
        spark.table(f"{database}.{name}").createOrReplaceTempView(name)
    return names


def layer_views(spark: SparkSession, layers: Sequence[str] = LAYERS) -> list[str]:
    """A view ``<layer>_<table>`` for every table of every layer."""
    views = []
    for layer in layers:
        for table in spark.catalog.listTables(layer):
            if table.isTemporary:
                continue
            view = f"{layer}_{table.name}"
            spark.table(f"{layer}.{table.name}").createOrReplaceTempView(view)
            views.append(view)
    return sorted(views)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table; parquet counts come from file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
