"""A play log whose appends and compactions are commits.

Rows lie in folders that never change.  A numbered commit says which folders each month is read from; publishing it fails if another writer
has taken the number.  What a writer has written isn't read until then, so a job that fails, or a driver that dies, leaves the log as it was.

An append classifies its batch and writes it in one pass, by outcome; how many rows are new, updated or unchanged is counted in
what was written, and unchanged rows are named by no commit.  A compaction rewrites only months that have rows to drop.  A writer that comes second goes on
from the other's commit: as it stands if that can't change what it did, else anew.  So appends and compactions may run side by side.

Defined results: rows without id or seconds aren't observations and are left out; an empty batch makes no commit; rows that repeat
are unchanged; columns that the schema doesn't have aren't kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playlake.operators.store import classify_append, compact_counts, current
from playlake.schema import PLAY, month_of
from playlake.sources.state import StateFiles

OUTCOMES = ("new", "updated", "unchanged")


@dataclass(frozen=True)
class Commit:
    version: int = 0
    kind: str = ""
    #: Months that it added rows to, or rewrote.
    touched: list[str] = field(default_factory=list)
    #: Folders by month.
    months: dict[str, list[str]] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=dict)


class PlayLog:
    """The log below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = StateFiles(spark, f"{self.path}/commits")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names() if n[:-5].isdigit())

    def commit(self, version: int | None = None) -> Commit:
        """A commit, by default the last one."""
        version = (self.versions() or [0])[-1] if version is None else version
        return Commit(version, **json.loads(self.files.read(f"{version:08d}.json"))) if version else Commit()

    def read(self, commit: Commit | None = None, months: Sequence[str] | None = None) -> DataFrame:
        """All observations of some months, by default of all; of a commit, by default of the last one."""
        held = (commit or self.commit()).months
        paths = [f"{self.path}/{folder}" for m in sorted(held) if months is None or m in months for folder in held[m]]
        rows = self.spark.read.schema(PLAY).parquet(*paths) if paths else self.spark.createDataFrame([], PLAY)
        return rows.withColumn("month", month_of("uts"))

    def _publish(self, commit: Commit) -> bool:
        said = {k: v for k, v in vars(commit).items() if k != "version"}
        return self.files.publish(f"{commit.version:08d}.json", json.dumps(said))

    def _since(self, version: int) -> list[Commit]:
        return [self.commit(v) for v in self.versions() if v > version]

    def _drop(self, folder: str) -> None:
        StateFiles(self.spark, self.path).delete(folder)

    def append(self, batch: DataFrame, tries: int = 5, before_commit: Callable[[], None] | None = None) -> dict[str, int]:
        """Add a batch's new and updated rows; how many rows had each outcome.  ``before_commit`` is called when all is written and nothing published."""
        rows = batch.filter("id is not null and uts is not null").select(*PLAY.names, month_of("uts").alias("month"))
        for _ in range(tries):
            head, folder = self.commit(), f"data/{uuid.uuid4().hex}"
            # An id has its seconds in it, so rows of other months aren't its earlier ones.
            touched = sorted(r["month"] for r in rows.select("month").distinct().collect())
            if not touched:
                return dict.fromkeys(OUTCOMES, 0)
            classes = classify_append(self.read(head, touched), rows).select(*PLAY.names, "outcome", "month")
            classes.repartitionByRange("outcome", "month", "uts", "id").sortWithinPartitions("outcome", "month", "uts", "id").write.partitionBy("outcome", "month").parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(T.StructType([*PLAY.fields, T.StructField("outcome", T.StringType()), T.StructField("month", T.StringType())])).parquet(f"{self.path}/{folder}")
            counts = written.groupBy("outcome", "month").count().collect()  # three rows a month at most
            stats = {o: sum(r["count"] for r in counts if r["outcome"] == o) for o in OUTCOMES}
            added: dict[str, list[str]] = {}
            for r in sorted(counts):
                if r["outcome"] != "unchanged":
                    added.setdefault(r["month"], []).append(f"{folder}/outcome={r['outcome']}/month={r['month']}")
            if before_commit:
                before_commit()
            if not added:
                self._drop(folder)
                return stats
            base = head
            while not self._publish(Commit(base.version + 1, "append", sorted(added), base.months | {m: base.months.get(m, []) + f for m, f in added.items()}, stats)):
                later = self._since(base.version)
                if any(c.kind == "append" and set(c.touched) & set(touched) for c in later):
                    break  # outcomes may be others by now
                base = later[-1]
            else:
                self._drop(f"{folder}/outcome=unchanged")
                return stats
            self._drop(folder)
        raise RuntimeError("other writers' commits came first each time")

    def compact(self, most_folders: int | None = None, tries: int = 5, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """Keep each id's winner, tombstones too, in months that have other rows, or with ``most_folders`` that are read from more folders.

        One row per month: month, n_rows, kept, dropped, rewritten.  Months that aren't rewritten keep their files.
        """
        for _ in range(tries):
            head, folder = self.commit(), f"data/{uuid.uuid4().hex}"
            counts = compact_counts(self.read(head)).collect()  # a row a month
            chosen = sorted(r["month"] for r in counts if r["dropped"] or (most_folders is not None and len(head.months[r["month"]]) > most_folders))
            told = self.spark.createDataFrame([(*r, r["month"] in chosen) for r in counts], "month string, n_rows long, kept long, dropped long, rewritten boolean")
            if not chosen:
                return told
            winners = current(self.read(head, chosen)).select(*PLAY.names, "month")
            winners.repartitionByRange("month", "uts", "id").sortWithinPartitions("month", "uts", "id").write.partitionBy("month").parquet(f"{self.path}/{folder}")
            if before_commit:
                before_commit()
            base = head
            while True:
                # Folders that appends have added since stay beside the rewritten ones.
                months = base.months | {m: [f"{folder}/month={m}"] + [f for f in base.months[m] if f not in head.months[m]] for m in chosen}
                if self._publish(Commit(base.version + 1, "compact", chosen, months, {"dropped": sum(r["dropped"] for r in counts)})):
                    return told
                later = self._since(base.version)
                if any(c.kind == "compact" and set(c.touched) & set(chosen) for c in later):
                    break
                base = later[-1]
            self._drop(folder)
        raise RuntimeError("other writers' commits came first each time")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` commits don't name.  No writer may be under way, since its folders are named by none yet."""
        versions = self.versions()
        named = {f.split("/")[1] for v in versions[-keep:] for folders in self.commit(v).months.values() for f in folders}
        data = StateFiles(self.spark, f"{self.path}/data")
        for name in data.names():
            if name not in named:
                data.delete(name)
        for version in versions[:-keep]:
            self.files.delete(f"{version:08d}.json")
