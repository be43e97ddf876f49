"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage, survives the loss of executors and, unlike a cached or checkpointed plan, is read
with its own exchange, so that adaptive execution may split the hot keys of a join on it.

An operator that writes several opens a :class:`Scope`: at its end all are deleted but those that the operator's result reads.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of narrow tables (a few numbers each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
_FOLDERS: dict[str, str] = {}
_SCOPES: list[Scope] = []


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the folder's owner cleans it then
        pass


class Scope:
    """``with Scope(spark) as scope``: tables that are materialised within go at its end, unless kept; kept ones pass to the scope around."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """A materialised table that is read after the scope's end."""
        self.kept.append(table.scratch_path)
        return table

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for path in self.paths:
            if path not in self.kept:
                _remove(self.spark, path)
            elif _SCOPES:
                _SCOPES[-1].paths.append(path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files as they end, not when the driver happens to collect its garbage; for tables that are run once."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it the context's checkpoint folder; on a single machine a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = held.get()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="playlake-")


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one, deleted when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{_root(spark).rstrip('/')}/playlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`folder` that no other call gets."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a written table with a known schema, also where it has no rows or files."""
    return spark.read.schema(like.schema).parquet(path)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back; within a :class:`Scope`, until its end.  ``by``, the last column: a folder for each of its values."""
    path = new_path(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = reread(df.sparkSession, path, df)
    table.scratch_path = path
    return table


def small(table: DataFrame) -> DataFrame:
    """A narrow materialised table for a join: broadcast if it has no more than :data:`BROADCAST_ROWS` rows, so that the other side isn't shuffled; else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
