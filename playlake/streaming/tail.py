"""Tail ingest: lines that are appended to files that grow, each once, from recorded byte offsets.

The file source of Spark sees new files only.  This one's offset is a number of bytes by file, always behind a line's end, so that a last line
without its break stays until it is whole.  A micro-batch reads the bytes between two offsets, in pieces of bounded size, each by a task of its own;
the checkpoint keeps the offsets, so a restart goes on where the last batch ended.  Files are reached through Arrow's file systems (local ones, HDFS,
object stores), since Python's readers of a data source have no JVM beside them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from playlake.schema import PLAY
from playlake.shipping import ship
from playlake.sources.state import StateFiles
from playlake.streaming.merge import View, merge_batch

#: Bytes that one task reads, and that are read at once.
PIECE, BLOCK = 64 << 20, 1 << 16
_LINES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])


class RewrittenLog(ValueError):
    """A file that was read from is gone or shorter than before: what follows isn't an append."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path on it, from an address or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str = ".json") -> dict[str, int]:
    """The files below a folder, by their path below it, with their sizes; hidden ones aren't looked at."""
    files, root = opened(path)
    root = root.rstrip("/")
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    below = {info.path[len(root) + 1 :]: info.size for info in found if info.is_file and info.path.endswith(suffix)}
    return {name: size for name, size in sorted(below.items()) if not any(step[:1] in "._" for step in name.split("/"))}


def whole_until(path: str, name: str, start: int, size: int) -> int:
    """How far a file has whole lines: behind the last line's end between ``start`` and ``size``."""
    files, root = opened(path)
    with files.open_input_file(f"{root.rstrip('/')}/{name}") as file:
        end = size
        while end > start:
            begin = max(start, end - BLOCK)
            file.seek(begin)
            if (at := file.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return start


@dataclass
class Piece(InputPartition):
    """Bytes of a file; the lines that begin in them."""

    file: str
    start: int
    end: int
    stop: int

    def __init__(self, file: str, start: int, end: int, stop: int):
        self.file, self.start, self.end, self.stop = file, start, end, stop


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".json")
        self.piece = int(options.get("pieceBytes", PIECE))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = sizes(self.path, self.suffix)
        for name, size in now.items():
            known = self.known.get(name, 0)
            if size > known:
                self.known[name] = whole_until(self.path, name, known, size)
        return {name: end for name, end in self.known.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        now = sizes(self.path, self.suffix)
        lost = [name for name, known in start.items() if now.get(name, -1) < known]
        if lost:
            raise RewrittenLog(f"{lost[0]} is gone or shorter than it was")
        found = []
        for name, stop in sorted(end.items()):
            at = start.get(name, 0)
            while at < stop:
                found.append(Piece(name, at, min(stop, at + self.piece), stop))
                at += self.piece
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        with files.open_input_file(f"{root.rstrip('/')}/{partition.file}") as file:
            # A line belongs to the piece in which it begins: unless the byte before ends a line, the first one is another's.
            at = max(0, partition.start - 1)
            file.seek(at)
            rest, skipping = b"", partition.start > 0
            while at + len(rest) < partition.stop and at < partition.end:
                block = file.read(min(BLOCK, partition.stop - at - len(rest)))
                if not block:
                    break
                *lines, rest = (rest + block).split(b"\n")
                rows = []
                for line in lines:
                    if not skipping and partition.start <= at < partition.end and line.strip():
                        rows.append((partition.file, at, line.decode("utf-8", "replace")))
                    skipping, at = False, at + len(line) + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``: file, at (byte), line.  Options: ``suffix`` of the files (.json), ``pieceBytes`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The whole lines of all files below ``path``, as they are appended."""
    ship(spark)
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, **options).load()


def records(lines: Column, schema: T.StructType) -> Column:
    """A line as a record; null for a torn one."""
    read = F.from_json(lines, T.StructType([*schema.fields, T.StructField("__torn", T.StringType())]), {"columnNameOfCorruptRecord": "__torn"})
    return F.when(read["__torn"].isNull(), read)


def tail_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The observations of a log whose files grow; torn lines within a file are left out."""
    found = tail_lines(spark, path, **options).select(records(F.col("line"), PLAY).alias("r")).filter("r.id is not null")
    return found.select(*(F.col(f"r.{n}").alias(n) for n in PLAY.names))


def tail_available(spark: SparkSession, log_path: str, view_path: str, checkpoint: str, **options) -> None:
    """Merge what was appended since the last time into the view.

    Where a file was rewritten (a compaction), the view is built anew from all of the log, under a checkpoint of its own.
    """
    files = StateFiles(spark, checkpoint)
    name = files.read("current") or uuid.uuid4().hex
    files.write("current", name)

    def run(at: str) -> None:
        stream = tail_log(spark, log_path, **options).writeStream.foreachBatch(merge_batch(view_path))
        stream.option("checkpointLocation", f"{checkpoint}/{at}").trigger(availableNow=True).start().awaitTermination()

    try:
        run(name)
    except Exception as error:
        if RewrittenLog.__name__ not in str(error):
            raise
        View(spark, view_path).clear()
        files.write("current", name := uuid.uuid4().hex)
        run(name)
