"""Session settings the engine relies on, and where lineage may be cut."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Behaviour, not sizing: sizes belong to the cluster's own configuration.
# A hot join key is split at run time, even where that costs another shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM never compiles a longer method and would interpret it row by row
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
SETTINGS = {
    **ADAPTIVE,
    "spark.sql.session.timeZone": "UTC",
    # call-site capture costs a round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gaugeworks")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive behaviour the plans count on, in a session of any origin."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would lose data with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPES: list[list[str]] = []


def written(df: DataFrame, *partition_by: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """``materialize``, by folders of ``partition_by``, with the path, which ``remove`` takes."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    options = {"compression": codec} if codec else {}
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what a job writes in a layout of its own; removed like materialized tables."""
    path = f"{shared_folder(spark)}/gaugeworks-{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several consumers read to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later plans real sizes. The
    files go when the enclosing ``scratch`` scope ends, or else with the application.
    """
    return written(df)[0]


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The files under ``path`` go with the enclosing ``scratch`` scope or with the application."""
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    if _SCOPES:
        _SCOPES[-1].append(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove files before that, when nothing reads them any more."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what was materialized inside the block; results must be read before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is built and run inside removes its shuffle files as each job ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python in batches of so many rows; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input that has fewer splits than there are cores.

    A small file is one split and would be worked on by one task. A large input
    has far more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
