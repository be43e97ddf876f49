"""Labelled texts to learn from, all or a bounded sample, learning in the tasks, and splits by id.

Classifiers learn from all labelled rows.  These are dealt into segments of some thousand rows by the hash of their ids; in each
round the tasks learn from one segment after the other, each time from the same state, and the changes are averaged: a
row of a table (a feature's numbers) over the segments that changed it.  Through the driver pass the state and its changes, whose size the model's constants set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from playlake.llm.scratch import freed_shuffles, materialize, small
from playlake.llm.worker import bound_batches

#: Rows of a segment, about; where texts are long, a segment is learnt from in parts of so many characters.
SEGMENT_ROWS, SEGMENT_CHARS = 4000, 12_000_000
#: Rows of a state's table that are averaged together.
CHUNK_ROWS = 1 << 14

#: The documented bounds of a training sample: rows, characters of a text that may be in it, characters in all.
SAMPLE_ROWS, SAMPLE_TEXT_CHARS, SAMPLE_CHARS = 6000, 200_000, 30_000_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text (null: empty) modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, extra: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> list:
    """At most ``rows`` Rows (text, y, *extra) of labelled documents, the same ones in every run.

    Ids are chosen first, by hash, from the narrow labels; only their texts are fetched.  A label that is null is none; of
    labels that repeat for an id the greatest counts; of documents that repeat an id the one whose text comes first.
    """
    docs = docs.select("doc_id", "text", *extra)  # other columns may be named like those added here
    marked = labels.select("doc_id", label).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = marked.select("doc_id", "y", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(rows)
    found = docs.join(F.broadcast(chosen), "doc_id").select("turn", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", *extra)
    found = found.filter(F.char_length("text") <= SAMPLE_TEXT_CHARS)
    one = found.groupBy("turn", "doc_id").agg(F.min(F.struct("text", "y", *extra)).alias("row")).select("turn", "doc_id", "row.*")
    out, size = [], 0
    for row in sorted(one.collect(), key=lambda r: (r["turn"], r["doc_id"])):
        size += len(row["text"])
        if size > SAMPLE_CHARS:
            break
        out.append(row)
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """All labelled documents, written: segment, turn, doc_id, text, y, *extra; a segment's rows are in one file, in the order of ``turn``.

    Labels and documents that repeat an id count as in :func:`sample`.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text", *extra)
    marked = labels.select("doc_id", label).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).alias("y"))
    marked = materialize(marked, "marked")
    segments = max(1, round(marked.count() / SEGMENT_ROWS))
    found = docs.join(small(marked), "doc_id").withColumn("turn", F.xxhash64("doc_id")).withColumn("segment", F.pmod("turn", F.lit(segments)))
    found = found.select("segment", "turn", "doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), "y", *extra).alias("row"))
    one = found.repartition(segments, "segment").groupBy("segment", "turn", "doc_id").agg(F.min("row").alias("row")).sortWithinPartitions("segment", "turn", "doc_id")
    with freed_shuffles(spark):
        return materialize(one.select("segment", "turn", "doc_id", "row.*"), "learning")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(segment, texts, labels) of rows (segment, text, y) that follow one another."""
    now, texts, y, size = None, [], [], 0
    for batch in batches:
        for segment, text, label in zip(*(batch.column(c).to_pylist() for c in ("segment", "text", "y")), strict=True):
            if texts and (segment != now or size + len(text) > SEGMENT_CHARS):
                yield now, texts, np.array(y, float)
                texts, y, size = [], [], 0
            now, size = segment, size + len(text)
            texts.append(text)
            y.append(label)
    if texts:
        yield now, texts, np.array(y, float)


def _total(partial: DataFrame, schema: str, add: Callable) -> DataFrame:
    """Rows (name, chunk, ...) of the tasks, those of one name and chunk taken together by ``add``, always in the same order."""
    return partial.repartition("name", "chunk").sortWithinPartitions("name", "chunk", "task").mapInArrow(add, schema)


_PARTIAL = "name string, chunk int, task int, rows binary, times binary, changes binary"
_MEAN = "name string, rows binary, changes binary"


def _adding(width: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, total = None, None, None

        def mean() -> pa.RecordBatch:
            rows = np.flatnonzero(times)
            changes = (total[rows] / times[rows, None]).astype(np.float32)
            return pa.RecordBatch.from_pylist([{"name": now[0], "rows": (rows + now[1] * CHUNK_ROWS).tobytes(), "changes": changes.tobytes()}], pa.schema([("name", pa.string()), ("rows", pa.binary()), ("changes", pa.binary())]))

        for batch in batches:
            for r in batch.to_pylist():
                if (r["name"], r["chunk"]) != now:
                    if now:
                        yield mean()
                    now, times, total = (r["name"], r["chunk"]), np.zeros(CHUNK_ROWS, np.int64), np.zeros((CHUNK_ROWS, width[r["name"]]))
                rows = np.frombuffer(r["rows"], np.int64)
                times[rows] += np.frombuffer(r["times"], np.int64)
                total[rows] += np.frombuffer(r["changes"], np.float32).reshape(len(rows), -1)
        if now:
            yield mean()

    return run


def learn_round(rows: DataFrame, state: dict[str, np.ndarray], learn: Callable[[dict[str, np.ndarray], int, list[str], np.ndarray], None]) -> None:
    """One round over all ``rows`` (segment, text, y): ``learn`` changes a copy of ``state`` (arrays of rows) by a segment; the mean changes go into ``state``."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        times = {k: np.zeros(len(a), np.int64) for k, a in before.items()}
        total = {k: np.zeros(a.shape, np.float32) for k, a in before.items()}
        for segment, texts, y in _runs(batches):
            own = {k: a.copy() for k, a in before.items()}
            learn(own, segment, texts, y)
            for k, a in own.items():
                a -= before[k]
                times[k] += a.any(axis=1)
                total[k] += a
        task = TaskContext.get().partitionId()
        for k, n in times.items():
            for lo in range(0, len(n), CHUNK_ROWS):
                met = np.flatnonzero(n[lo : lo + CHUNK_ROWS])
                if len(met):
                    columns = [pa.array([k]), pa.array([lo // CHUNK_ROWS], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (met, n[lo + met], total[k][lo + met]))]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "chunk", "task", "rows", "times", "changes"])

    partial = rows.select("segment", "text", "y").mapInArrow(run, _PARTIAL)
    with freed_shuffles(rows.sparkSession):
        mean = materialize(_total(partial, _MEAN, _adding({k: a.shape[1] for k, a in state.items()})), "changes")
    for r in mean.toLocalIterator():  # as many numbers as the state has
        where = np.frombuffer(r["rows"], np.int64)
        state[r["name"]][where] += np.frombuffer(r["changes"], np.float32).reshape(len(where), -1)
    shared.destroy()


def summed(rows: DataFrame, count: Callable[[list[str]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all ``rows`` (text) of what ``count`` finds in lists of texts: ``size`` whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column("text").to_pylist())
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(total[where], pa.int64())], ["place", "n"])

    found = rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    out = np.zeros(size, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out
