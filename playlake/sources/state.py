"""Small state beside the play log, as files: rules, coverage, sync state, event logs, deletion manifests.

Each of these is small (a person's rules, ranges and decisions) and is written whole by a rename, so that readers see the old file
or the new one.  Event logs and anything that grows with the plays are tables of files instead.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playlake.operators import interval
from playlake.schema import COVERAGE


class StateFiles:
    """Files of one folder, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._java, self.path = spark._jvm.org.apache.hadoop.fs, path.rstrip("/")
        self._gateway, self._conf = spark._sc._gateway, spark._jsc.hadoopConfiguration()
        self._fs = self._java.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._java.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        folder = self._java.Path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def read(self, name: str, missing: str | None = None) -> str | None:
        """A file's text; ``missing`` if there is none."""
        if not self._fs.exists(self._at(name)):
            return missing
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file whole or not at all."""
        temporary = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(text.encode())
        stream.close()
        if not self._fs.rename(temporary, self._at(name)):  # a store whose plain rename doesn't replace
            self._rename(temporary, self._at(name), "OVERWRITE")

    def _rename(self, source, target, how: str) -> None:
        """A rename in one step, with what is to happen where the target exists."""
        options = self._gateway.new_array(self._java.Options.Rename, 1)
        options[0] = getattr(self._java.Options.Rename, how)
        self._java.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(source, target, options)

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole, unless there is one of this name: then nothing, and false.  Of several writers one wins.

        The name is given in one step that fails if it is taken: a hard link on this machine's file systems, else a rename that doesn't
        replace, which HDFS does in one step; on object stores, which have no such step, there must be one writer.
        """
        temporary = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(text.encode())
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = [self._java.Path.getPathWithoutSchemeAndAuthority(p).toString() for p in (temporary, self._at(name))]
                os.link(*local)
            else:
                self._rename(temporary, self._at(name), "NONE")
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        finally:
            self._fs.delete(temporary, False)
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def safe_name(provider: str) -> str:
    """A provider's name as a file's: other characters than letters, digits, ``_`` and ``-`` become ``_``."""
    return re.sub(r"[^\w-]", "_", provider)


def save_rules(spark: SparkSession, path: str, rows: list[dict]) -> None:
    StateFiles(spark, path).write("rules.json", json.dumps(rows, indent=1))


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules as written; none if there is no file."""
    return json.loads(StateFiles(spark, path).read("rules.json", "[]"))


def save_coverage(spark: SparkSession, path: str, coverage: DataFrame, provider: str | None = None) -> None:
    """Ranges of one map, of the store or of a provider: few, since they are merged where they touch."""
    rows = [r.asDict() for r in interval.normalise(coverage).orderBy("start").toLocalIterator()]
    StateFiles(spark, path).write(f"coverage-{safe_name(provider)}.json" if provider else "coverage.json", json.dumps(rows))


def load_coverage(spark: SparkSession, path: str, provider: str | None = None) -> DataFrame:
    """Ranges as written, normalised again, so that files which two machines' lines were merged in heal; none if there is no file."""
    text = StateFiles(spark, path).read(f"coverage-{safe_name(provider)}.json" if provider else "coverage.json", "[]")
    rows = [(r["start"], r["end"], r["verified_at"]) for r in json.loads(text)]
    return interval.normalise(spark.createDataFrame(rows, COVERAGE))


def save_state(spark: SparkSession, path: str, **facts) -> None:
    """Facts of a sync: last_sync_at, history_start, and the like."""
    StateFiles(spark, path).write("state.json", json.dumps(load_state(spark, path) | facts))


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(StateFiles(spark, path).read("state.json", "{}"))


def append_events(events: DataFrame, path: str) -> None:
    """Add events to a log, as new files of one JSON object a line."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events of a log (``schema`` has id and seq).  Blank and torn lines are left out, wherever they stand."""
    wanted = T.StructType.fromDDL(schema)
    rows = spark.read.schema(wanted.add("_corrupt_record", "string")).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


MANIFEST_VERSION = 1
_TARGET = "index long, offset long, artist string, track string, album string, timestamp long"


def write_manifest(targets: DataFrame, path: str, source: str, generated_at: int) -> None:
    """A deletion manifest: the plays to delete (index from 1, offset?, artist, track, album?, timestamp) as lines, and a head with version, source, time."""
    targets.select(*[f.split()[0] for f in _TARGET.split(", ")]).write.json(f"{path}/targets")
    StateFiles(targets.sparkSession, path).write("head.json", json.dumps({"version": MANIFEST_VERSION, "generated_at": generated_at, "source": source}))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The plays of a manifest; other versions are refused."""
    version = json.loads(StateFiles(spark, path).read("head.json", "{}")).get("version")
    if version != MANIFEST_VERSION:
        raise ValueError(f"unsupported deletion manifest version {version}")
    return spark.read.schema(_TARGET).json(f"{path}/targets")


def lines(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as lines for programs: one JSON object each, with ``event``; nulls are left out."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("event"), *rows.columns)).alias("line"))
