"""Continuous mode: new log files are merged into the current view, once each.

Every append writes new files, so the file source sees all of it.  A batch is merged into the months that it touches only;
a checkpoint remembers which files are done, and as the merge is last-write-wins, a batch that comes twice changes nothing.

The view is a folder of immutable files: a merge writes the months it touches into a folder of their own, and then a small
numbered manifest says which folder each month is read from.  So a merge that breaks off anywhere leaves the view as it was,
and readers see one version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from playlake.operators.store import current
from playlake.schema import PLAY, month_of
from playlake.sources.state import StateFiles

class View:
    """The current view below a path: one row per id, tombstones too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), StateFiles(spark, f"{path.rstrip('/')}/manifests")

    def version(self) -> int:
        return max((int(n[:-5]) for n in self.files.names() if n[:-5].isdigit()), default=0)

    def months(self) -> dict[str, str]:
        """Folder by month, of the last version."""
        version = self.version()
        return json.loads(self.files.read(f"{version:08d}.json")) if version else {}

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The rows of some months, by default of all."""
        found = self.months()
        paths = [f"{self.path}/{folder}/month={m}" for m, folder in sorted(found.items()) if months is None or m in months]
        rows = self.spark.read.schema(PLAY).parquet(*paths) if paths else self.spark.createDataFrame([], PLAY)
        return rows.withColumn("month", month_of("uts"))

    def merge(self, rows: DataFrame) -> None:
        """Fold observations in and switch to the new version."""
        months = [r["month"] for r in rows.select("month").distinct().collect()]  # calendar months of one batch
        if not months:
            return
        merged = current(self.read(months).unionByName(rows.select(*PLAY.names, "month")))
        folder = f"data/{uuid.uuid4().hex}"
        merged.repartitionByRange("month", "uts", "id").sortWithinPartitions("month", "uts", "id").write.partitionBy("month").parquet(f"{self.path}/{folder}")
        version = self.version() + 1
        self.files.write(f"{version:08d}.json", json.dumps(self.months() | dict.fromkeys(months, folder)))
        self.vacuum(version)

    def clear(self) -> None:
        """Switch to a version without rows."""
        self.files.write(f"{self.version() + 1:08d}.json", "{}")

    def vacuum(self, version: int) -> None:
        """Delete what neither this version nor the one before reads, for readers that have just begun."""
        named = set()
        for v in (version, version - 1):
            if v > 0:
                named |= set(json.loads(self.files.read(f"{v:08d}.json")).values())
        data = StateFiles(self.spark, f"{self.path}/data")
        for folder in data.names():
            if f"data/{folder}" not in named:
                data.delete(folder)
        for name in self.files.names():
            if name[:-5].isdigit() and int(name[:-5]) < version - 1:
                self.files.delete(name)


def stream_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The log's lines as a stream; torn ones are left out."""
    return spark.readStream.schema(PLAY).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").json(path)


def merge_batch(view_path: str):
    """A ``foreachBatch`` function that folds a batch into the view below ``view_path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("id is not null").withColumns({"month": month_of("uts"), "deleted": F.coalesce("deleted", F.lit(False))})
        View(batch.sparkSession, view_path).merge(rows)

    return merge


def run_available(spark: SparkSession, log_path: str, view_path: str, checkpoint: str) -> None:
    """One cycle: merge whatever files are new, then stop."""
    query = stream_log(spark, log_path).writeStream.foreachBatch(merge_batch(view_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
