"""What several operators of this subpackage share: columns, splits and shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import batches_of  # noqa: F401

# A word is a maximal run of anything but ASCII white space; bytes.split() cuts the same way.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def held_out(doc_id: str, divisor: int) -> Column:
    """Rows with remainder 1. A row without an id is never held out."""
    return F.coalesce(remainder(doc_id, divisor) == 1, F.lit(False))


def learnable(doc_id: str, divisor: int) -> Column:
    """Rows a model may learn from. A row without an id is not learned from."""
    return F.coalesce(remainder(doc_id, divisor) != 1, F.lit(False))


def sized(rows: int, per_partition: int) -> int:
    """Partitions for a repartition whose size follows the data."""
    return max(1, -(-rows // per_partition))
