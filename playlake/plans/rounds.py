"""Rounds of continuous mode that take effect at once: log, view, queue, coverage and facts by one numbered commit.

A round writes whatever it adds into folders of its own, then publishes a commit that names them: the folders of the log and of the queue, the folder that each
month of the view is read from, every provider's ranges, and the facts of the sync.  Publishing fails if another writer has taken the number; the
round then begins anew from that writer's commit.  Until then nothing that it wrote is read, so a round may end anywhere: what a reader sees
is the commit before or the commit after, and a round that is begun again comes to the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playlake.operators import interval
from playlake.operators.store import current
from playlake.plans import planner, sync
from playlake.plans.providers import EVENTS, Provider, plan_with
from playlake.schema import COVERAGE, PLAY, month_of
from playlake.sources.state import StateFiles

_KINDS = {"seq": T.LongType(), "at": T.LongType(), "requires_approval": T.BooleanType(), "dismiss": T.BooleanType()}
QUEUE = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in EVENTS])
SYNCED = ""  # the store's own ranges, beside the providers'


@dataclass(frozen=True)
class Head:
    """What a commit names."""

    version: int = 0
    log: list[str] = field(default_factory=list)
    queue: list[str] = field(default_factory=list)
    view: dict[str, str] = field(default_factory=dict)
    coverage: dict[str, list[list[int]]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Rounds:
    """The commits below a folder, and the tables that they name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = StateFiles(spark, f"{self.path}/commits")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names() if n[:-5].isdigit())

    def head(self, version: int | None = None) -> Head:
        """A commit, by default the last one."""
        version = (self.versions() or [0])[-1] if version is None else version
        return Head(version, **json.loads(self.files.read(f"{version:08d}.json"))) if version else Head()

    def write(self, rows: DataFrame, kind: str, by: str | None = None) -> str:
        """Rows as a folder of their own, which no commit names yet."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        writer = rows.write if by is None else rows.write.partitionBy(by)
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, head: Head) -> bool:
        """Make a head the commit after the one it was made from; false if there is one already."""
        said = {k: v for k, v in vars(head).items() if k != "version"}
        return self.files.publish(f"{head.version + 1:08d}.json", json.dumps(said))

    def _read(self, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def log(self, head: Head) -> DataFrame:
        return self._read(head.log, PLAY).withColumn("month", month_of("uts"))

    def queue(self, head: Head) -> DataFrame:
        return self._read(head.queue, QUEUE)

    def view(self, head: Head, months: Sequence[str] | None = None) -> DataFrame:
        """The current row of each id, tombstones too."""
        return self._read([f"{folder}/month={m}" for m, folder in sorted(head.view.items()) if months is None or m in months], PLAY).withColumn("month", month_of("uts"))

    def coverage(self, head: Head, provider: str = SYNCED) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in head.coverage.get(provider, [])], COVERAGE)

    def merged(self, head: Head, rows: DataFrame) -> dict[str, str]:
        """The view's months with observations folded in; only months that they touch are written."""
        months = [r["month"] for r in rows.select("month").distinct().collect()]  # calendar months of one round
        if not months:
            return head.view
        both = current(self.view(head, months).unionByName(rows.select(*PLAY.names, "month")))
        folder = self.write(both.repartitionByRange("month", "uts", "id").sortWithinPartitions("month", "uts", "id"), "view", "month")
        return head.view | dict.fromkeys(months, folder)

    def compact(self) -> bool:
        """The folders of log and queue as one each, by a commit like any other."""
        head = self.head()
        log = [self.write(self.log(head).drop("month"), "log")] if len(head.log) > 1 else head.log
        queue = [self.write(self.queue(head), "queue")] if len(head.queue) > 1 else head.queue
        return self.publish(Head(head.version, log, queue, head.view, head.coverage, head.facts))

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` commits don't name.  No round may be under way, since its folders are named by none yet."""
        versions = self.versions()
        named: set[str] = set()
        for version in versions[-keep:]:
            head = self.head(version)
            named |= {*head.log, *head.queue, *head.view.values()}
        for kind in ("log", "queue", "view"):
            folder = StateFiles(self.spark, f"{self.path}/{kind}")
            for name in folder.names():
                if f"{kind}/{name}" not in named:
                    folder.delete(name)
        for version in versions[:-keep]:
            self.files.delete(f"{version:08d}.json")


def _ranges(coverage: DataFrame) -> list[list[int]]:
    """Ranges of one map: few, since they are merged where they touch."""
    return [[r["start"], r["end"], r["verified_at"]] for r in interval.normalise(coverage.select("start", "end", "verified_at")).orderBy("start").toLocalIterator()]


def run_round(spark: SparkSession, path: str, pages: DataFrame, providers: Sequence[Provider], start: int, now: int, rules_hash: str | None = None, tries: int = 5, before_commit: Callable[[Head], None] | None = None, **policy) -> DataFrame:
    """One round: fetched pages into log and view, the providers over what is new to each, their suggestions into the queue; all of it in one commit.

    ``pages``: the service's answer as :func:`playlake.plans.sync.sync_pass` takes it.  ``rules_hash``: that of the rules; another one than the last commit's makes the provider
    ``rules`` look at everything again.  The result is the plan's report.  ``before_commit`` is called with the head that is about to be published.
    """
    rounds = Rounds(spark, path)
    for _ in range(tries):
        head = rounds.head()
        synced, log = rounds.coverage(head), rounds.log(head)
        fresh, synced = sync.sync_pass(pages, log, synced, start, now)
        added = rounds.write(fresh.select(*PLAY.names), "log")
        rows = rounds._read([added], PLAY).withColumn("month", month_of("uts"))
        view = rounds.merged(head, rows)
        covered = head.coverage | {SYNCED: _ranges(synced)}
        if rules_hash is not None and head.facts.get("rules_hash", rules_hash) != rules_hash:
            covered = {k: v for k, v in covered.items() if k != "rules"}
        staged = Head(head.version, [*head.log, added], head.queue, view, covered, head.facts)
        each = [rounds.coverage(staged, p.name).withColumn("provider", F.lit(p.name)) for p in providers]
        coverage = spark.createDataFrame([], T.StructType([*COVERAGE.fields, T.StructField("provider", T.StringType())]))
        for own in each:
            coverage = coverage.unionByName(own)
        plays = rounds.view(staged).filter("not deleted")
        folder = f"{rounds.path}/suggestions/{uuid.uuid4().hex}"
        found = plan_with(plays, providers, rounds.coverage(staged), coverage, rounds.queue(head), start, now, now, folder, **policy)
        told = planner.report(found.intents).collect()  # a row per outcome
        queued = rounds.write(found.events.select(*QUEUE.names), "queue")
        for provider in providers:
            covered[provider.name] = _ranges(found.coverage.filter(F.col("provider") == provider.name))
        facts = head.facts | {"last_sync_at": now, "failed": found.failed} | ({"rules_hash": rules_hash} if rules_hash is not None else {})
        done = Head(head.version, staged.log, [*head.queue, queued], view, covered, facts)
        if before_commit:
            before_commit(done)
        won = rounds.publish(done)
        StateFiles(spark, f"{rounds.path}/suggestions").delete(folder.rsplit("/", 1)[1])
        if won:
            return spark.createDataFrame(told, "outcome string, subjects long, plays long")
    raise RuntimeError("other writers' commits came first each time")
