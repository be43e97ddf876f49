"""Sharding by size-tiered compaction: small immutable shards, merges of similar sizes, a versioned manifest.

A store is a folder: ``shards/<id>/`` hold Parquet files that never change, ``manifests/<version>.json`` name the
shards of each version in order, with their files, rows and bytes.  The latest manifest is the store; a reader
sees one version, whatever is written meanwhile.

* ``append`` writes one Spark job's output, one shard for each arrival, and commits a manifest with the shards added.
* ``compact`` looks for runs of at least ``fan_in`` files of one size tier (powers of ``ratio``), merges each into files of about
  ``target_bytes`` and commits a manifest with the runs replaced, until no run is left.  Files of target size are let be, and a
  shard's total doesn't count: one of many small files is merged, however large it is.
  Rows are dealt round, so a large arrival is spread over files and tasks.
* ``read`` gives the rows of one version; a store with only empty arrivals has their columns and no rows.
* ``vacuum`` deletes files that no kept version names, and what failed jobs left behind long ago.

A commit writes the manifest beside its place and then gives it its name in one step that fails if the name is taken: a hard
link where the store is in a file system of this machine, else a rename that doesn't replace, which HDFS does in one step.  The
writer that loses reads the winner's manifest and tries again.  On an object store, which has no such step, commits need one writer.

A manifest names parts, files of at most :data:`PART_SHARDS` shards' entries.  Parts that a change doesn't touch are named again, so a
commit costs what it changes.  Shards are read as folders, so that only their names, not those of files, pass to the reader.

Defined results: an empty arrival adds no shard; null arrival names are one arrival of no name; rows that repeat are all kept; all
columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, FAN_IN, RATIO = 64 << 20, 4, 4
PART_SHARDS, ORPHAN_SECONDS = 500, 86_400


@dataclass(frozen=True)
class Shard:
    """One immutable shard, or those of its files that a version still names."""

    id: str
    files: tuple[str, ...]
    size: int
    arrivals: tuple[str | None, ...]
    #: Bytes of each file.
    sizes: tuple[int, ...]
    #: Whether these are all files of its folder.
    whole: bool = True

    def only(self, keep) -> Shard | None:
        """The shard with the files for which ``keep`` (name, bytes → bool) holds; None without any."""
        found = [(f, n) for f, n in zip(self.files, self.sizes, strict=True) if keep(f, n)]
        whole = self.whole and len(found) == len(self.files)
        return Shard(self.id, tuple(f for f, _ in found), sum(n for _, n in found), self.arrivals, tuple(n for _, n in found), whole) if found else None


class Store:
    """A sharded table below ``path``, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, ratio: int = RATIO):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.ratio = target_bytes, fan_in, ratio
        self._java = spark._jvm.org.apache.hadoop.fs
        self._fs = self._java.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes of what is in it) of a folder's entries."""
        at = self._java.Path(f"{self.path}/{folder}")
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _json(self, name: str) -> dict:
        stream = self._fs.open(self._java.Path(f"{self.path}/manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, name: str, what: dict):
        path = self._java.Path(f"{self.path}/manifests/{name}")
        stream = self._fs.create(path, False)
        stream.write(json.dumps(what).encode())
        stream.close()
        return path

    def manifest(self, version: int | None = None) -> dict:
        """What a version's manifest says, by default the latest's: version, parts (name → shards), columns."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "parts": {}, "columns": None}
        said = self._json(f"{version:08d}.json")
        return said | {"parts": {name: [Shard(s["id"], tuple(s["files"]), s["size"], tuple(s["arrivals"]), tuple(s["sizes"]), s["whole"]) for s in self._json(name)["shards"]] for name in said["parts"]}}

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default of the latest."""
        return [s for part in self.manifest(version)["parts"].values() for s in part]

    def _publish(self, temporary, name: str) -> bool:
        """Give a written file its name, in one step, unless the name is taken."""
        final = self._java.Path(f"{self.path}/manifests/{name}")
        if self._fs.getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(temporary, False)
            return True
        none = self._java.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(self._java.Options.Rename, 1)
        options[0] = none
        try:
            self._java.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def commit(self, change, columns: str | None = None) -> int:
        """Apply ``change`` (list of shards → list of shards) to the latest version and publish the result as the next.

        ``columns`` is the schema of new rows as JSON; without it that of the version before stays.
        """
        while True:
            before = self.manifest()
            version = before["version"] + 1
            wanted = change([s for part in before["parts"].values() for s in part])
            left, parts = set(wanted), []
            for name, part in before["parts"].items():
                if left.issuperset(part):
                    parts.append(name)
                    left.difference_update(part)
            fresh = [s for s in wanted if s in left]
            made = [f"part-{uuid.uuid4().hex}.json" for _ in range(0, len(fresh), PART_SHARDS)]
            for k, name in enumerate(made):
                self._write(name, {"shards": [asdict(s) for s in fresh[k * PART_SHARDS : (k + 1) * PART_SHARDS]]})
            temporary = self._write(f".{uuid.uuid4().hex}", {"version": version, "columns": columns or before["columns"], "parts": parts + made})
            if self._publish(temporary, f"{version:08d}.json"):
                return version
            for name in (temporary.getName(), *made):
                self._fs.delete(self._java.Path(f"{self.path}/manifests/{name}"), False)

    # -- data

    def _written(self, folder: str, arrivals: tuple[str | None, ...]) -> Shard | None:
        found = [(n, size) for n, size in self._names(f"shards/{folder}") if n.startswith("part-")]
        return Shard(folder, tuple(n for n, _ in found), sum(s for _, s in found), arrivals, tuple(s for _, s in found)) if found else None

    def append(self, rows: DataFrame, arrival_col: str | None = None) -> int:
        """Add rows, one shard for each value of ``arrival_col`` (without it, one shard); the new version."""
        base = uuid.uuid4().hex
        # A name's first character tells it from no name.
        arrival = F.coalesce(F.concat(F.lit("a"), F.col(arrival_col).cast("string")), F.lit("null")) if arrival_col else F.lit("aall")
        mark = "__arrival"
        while mark in (c.lower() for c in rows.columns):
            mark += "_"
        rows.withColumn(mark, arrival).write.option("compression", "zstd").partitionBy(mark).parquet(f"{self.path}/shards/{base}")
        new = []
        for name, _ in sorted(self._names(f"shards/{base}")):
            value = unquote(name[len(mark) + 1 :])
            if name.startswith(f"{mark}=") and (shard := self._written(f"{base}/{name}", (value[1:] if value[0] == "a" else None,))):
                new.append(shard)
        return self.commit(lambda shards: shards + new, rows.schema.json())

    def _tier(self, size: int) -> int:
        tier, limit = 0, 1 << 16
        while size > limit:
            tier, limit = tier + 1, limit * self.ratio
        return tier

    def _small(self, shards: list[Shard]) -> list[Shard]:
        """The shards with their files below half the target's size."""
        return [part for s in shards if (part := s.only(lambda _, n: n < self.target_bytes // 2))]

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of at least ``fan_in`` files of one tier, as parts of their shards; files of target size are left out."""
        tiers: dict[int, list[Shard]] = {}
        for shard in self._small(shards):
            for tier in {self._tier(n) for n in shard.sizes}:
                tiers.setdefault(tier, []).append(shard.only(lambda _, n, tier=tier: self._tier(n) == tier))
        return [group for _, group in sorted(tiers.items()) if sum(len(s.files) for s in group) >= self.fan_in]

    def compact(self, finish: bool = False) -> int:
        """Merge until no run is left; with ``finish`` also what remains below half the target.  The latest version."""
        while True:
            shards = self.shards()
            groups = self.runs(shards)
            if not groups and finish:
                rest = self._small(shards)
                groups, finish = ([rest] if sum(len(s.files) for s in rest) > 1 else []), False
            if not groups:
                return self.versions()[-1] if shards else 0
            self.commit(self._replacing([(g, self._merged(g)) for g in groups]))

    def _merged(self, group: list[Shard]) -> Shard:
        target = uuid.uuid4().hex
        files = max(1, round(sum(s.size for s in group) / self.target_bytes))
        rows = self._read(group, self.manifest()["columns"])
        rows.repartition(files).write.option("compression", "zstd").parquet(f"{self.path}/shards/{target}")
        return self._written(target, tuple(sorted({a for s in group for a in s.arrivals}, key=lambda a: (a is None, a or ""))))

    @staticmethod
    def _replacing(merges):
        def change(shards: list[Shard]) -> list[Shard]:
            for group, merged in merges:
                gone = {(s.id, f) for s in group for f in s.files}
                if not gone <= {(s.id, f) for s in shards for f in s.files}:
                    raise RuntimeError("another writer has merged these shards")
                shards = [left for s in shards if (left := s.only(lambda f, _, s=s: (s.id, f) not in gone))] + [merged]
            return shards

        return change

    def _read(self, shards: list[Shard], columns: str) -> DataFrame:
        at = lambda name: str(self._java.Path(self.path, name))
        paths = [p for s in shards for p in ([at(f"shards/{s.id}")] if s.whole else [at(f"shards/{s.id}/{f}") for f in s.files])]
        return self.spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None for a store that nothing was appended to."""
        shards, columns = self.shards(version), self.manifest(version)["columns"]
        if shards:
            return self._read(shards, columns)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(columns))) if columns else None

    def vacuum(self, keep_versions: int = 1, orphan_seconds: int = ORPHAN_SECONDS) -> int:
        """Delete the files that none of the last versions names, and the older manifests; of how many shards.

        Folders and parts that no version at all names are those of jobs that failed or still run: they go when they are older than ``orphan_seconds``.
        """
        known = self.versions()
        kept, old = known[-keep_versions:], known[:-keep_versions]
        said = {v: self.manifest(v)["parts"] for v in known}
        files = lambda versions: {(s.id, f) for v in versions for part in said[v].values() for s in part for f in s.files}
        named, parts = files(kept), {p for v in kept for p in said[v]}
        gone, shards = files(old) - named, {shard for shard, _ in named}
        delete = lambda name, deep=False: self._fs.delete(self._java.Path(f"{self.path}/{name}"), deep)
        for shard in {shard for shard, _ in gone} - shards:
            delete(f"shards/{shard}", True)
        for shard, file in gone:
            if shard in shards:
                delete(f"shards/{shard}/{file}")
        for version in old:
            delete(f"manifests/{version:08d}.json")
        tops, limit = {shard.split("/")[0] for shard in shards}, (time.time() - orphan_seconds) * 1000
        for folder, held in (("shards", tops), ("manifests", parts)):
            at = self._java.Path(f"{self.path}/{folder}")
            for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
                name = status.getPath().getName()
                past = name in {p for v in old for p in said[v]}
                if name not in held and not name[:-5].isdigit() and (past or status.getModificationTime() <= limit):
                    delete(f"{folder}/{name}", True)
        return len({shard for shard, _ in gone})
