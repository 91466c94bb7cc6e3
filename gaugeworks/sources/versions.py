"""Versioned tables: write, check, then switch one pointer.

A commit writes every table to a folder of its own, compares the rows on disk with the rows
that were observed while writing, runs the caller's checks on the files as read back, and
only then renames one small pointer file into place. The pointer names the folders of all
tables, so readers see the tables of one commit together: all old or all new. A commit that
dies before its rename leaves folders that no pointer names; ``expire`` removes them.

Pointers are numbered, and a number can be taken once: of two writers that start from the
same version, the second gets ``Conflict`` and nothing is lost. On an object store, where a
rename is a copy, the pointer still appears whole; run one writer at a time there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTERS, DATA = "_versions", "data"

Check = Callable[[DataFrame], None]


class Conflict(RuntimeError):
    """Another writer took the version number first."""


class Incomplete(RuntimeError):
    """The files do not hold the rows that were written."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    files = _files(spark, path)
    return list(files.listStatus(_path(spark, path))) if files.exists(_path(spark, path)) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed version numbers, ascending."""
    names = [s.getPath().getName() for s in _listed(spark, f"{root}/{POINTERS}")]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    text = spark.read.text(f"{root}/{POINTERS}/{version:012d}", wholetext=True).first()
    return json.loads(text[0])["tables"]


def _switch(spark: SparkSession, root: str, version: int, tables: Mapping[str, str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    # A name that starts with "." is not listed as a version and not read by Spark.
    draft = _path(spark, f"{root}/{POINTERS}/.draft-{uuid.uuid4().hex}")
    final = _path(spark, f"{root}/{POINTERS}/{version:012d}")
    files = _files(spark, root)
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"tables": dict(tables)}, sort_keys=True).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(draft, final, none)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"version {version} of {root} exists already") from e
        raise


def commit(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame],
    checks: Mapping[str, Sequence[Check]] | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    base: int | None = None,
) -> int:
    """Write ``tables`` as the next version and return its number.

    Tables of the version before that are not named stay as they are. A check raises to stop
    the commit; readers then keep what they had. ``base`` is the version the contents were
    computed from (by default the newest one now): if another one follows it, that is a
    ``Conflict``. A table may be read from the version it replaces.
    """
    checks, partition_by = checks or {}, partition_by or {}
    unknown = sorted((set(checks) | set(partition_by)) - set(tables))
    if unknown:
        raise ValueError(f"checks or partitions of tables that are not written: {', '.join(unknown)}")
    if base is None:
        base = max(versions(spark, root), default=0)
    named = _manifest(spark, root, base) if base else {}
    for name, df in tables.items():
        folder = f"{DATA}/{name}/{uuid.uuid4().hex}"
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
        columns = partition_by.get(name, ())
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{root}/{folder}")
        stored = spark.read.schema(df.schema).parquet(f"{root}/{folder}")
        found, sent = stored.count(), int(seen.get["n"])
        if found != sent:
            raise Incomplete(f"{name}: {sent} rows written, {found} rows found")
        for check in checks.get(name, ()):
            check(stored)
        named[name] = folder
    _switch(spark, root, base + 1, named)
    return base + 1


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of the one asked for."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if version not in versions(spark, root):
        raise LookupError(f"{root} has no version {version}")
    named = _manifest(spark, root, version)
    if table not in named:
        raise LookupError(f"version {version} of {root} has no table {table}")
    return spark.read.parquet(f"{root}/{named[table]}")


def expire(spark: SparkSession, root: str, keep: int = 2, min_age_seconds: float = 86_400) -> list[str]:
    """Remove all but the newest ``keep`` versions, and folders that no kept version names.

    Folders and pointers younger than ``min_age_seconds`` stay: a writer may not have switched yet, and
    a reader may have opened an old version. Returns the removed folders.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    files, now = _files(spark, root), time.time()

    def old(status) -> bool:
        return now - status.getModificationTime() / 1000 >= min_age_seconds

    numbers = versions(spark, root)
    for status in _listed(spark, f"{root}/{POINTERS}"):
        name = status.getPath().getName()
        if old(status) and (name.startswith(".draft-") or name.isdigit() and int(name) in numbers[:-keep]):
            files.delete(status.getPath(), False)
    named = {folder for v in versions(spark, root) for folder in _manifest(spark, root, v).values()}
    removed = []
    for table in _listed(spark, f"{root}/{DATA}"):
        name = table.getPath().getName()
        for status in _listed(spark, f"{root}/{DATA}/{name}"):
            folder = f"{DATA}/{name}/{status.getPath().getName()}"
            if folder not in named and old(status):
                files.delete(status.getPath(), True)
                removed.append(folder)
    return sorted(removed)
