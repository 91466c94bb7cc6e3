"""JDBC: scans of a pushed-down subquery and full-replace loads.

The driver jar and the database are the user's; these functions only set up the
Spark reader and writer. ``jdbc_options`` holds the part that can be checked
without a database.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugeworks.contracts import contract_ddl, enforce_contract


@dataclass(frozen=True)
class JdbcConfig:
    url: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"

    def options(self) -> dict[str, str]:
        return {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}


@dataclass(frozen=True)
class Split:
    """How a scan is cut into parallel range queries over one numeric column."""

    column: str
    lower: int
    upper: int
    partitions: int


def jdbc_options(
    config: JdbcConfig, subquery: str, split: Split | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    """The database plans and runs the subquery; Spark reads its rows, in ranges if told how."""
    options = {
        **config.options(),
        "dbtable": f"({subquery.strip().rstrip(';')}) AS extract",
        "fetchsize": str(fetch_size),
    }
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return options


def read_subquery(
    spark: SparkSession,
    config: JdbcConfig,
    subquery: str,
    split: Split | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config, subquery, split, fetch_size)).load()


def column_types(schema: T.StructType) -> str:
    """``createTableColumnTypes`` of a contract; string columns are left to the store's own dialect."""
    return contract_ddl(T.StructType([f for f in schema if not isinstance(f.dataType, T.StringType)]))


def replace_table(
    df: DataFrame,
    config: JdbcConfig,
    table: str,
    schema: T.StructType | None = None,
    batch_size: int = 10_000,
    connections: int = 16,
) -> None:
    """Overwrite a serving table; the table definition is kept and only its rows go.

    ``connections`` bounds how many tasks write at once.
    """
    options: Mapping[str, str] = {"truncate": "true", "batchsize": str(batch_size)}
    if schema is not None:
        df = enforce_contract(df, schema, table)
        options = {**options, "createTableColumnTypes": column_types(schema)}
    writer = df.write.format("jdbc").mode("overwrite").options(**config.options(), **options)
    writer.option("dbtable", table).option("numPartitions", str(connections)).save()
