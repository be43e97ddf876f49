"""Greedy batches of one long sequence, in parallel: spans of time tell what they do to an open batch, then each is cut by itself.

A batch ends behind the first second that brings it to so many plays, so where batches end depends on all before.  But what a span of time does depends
only on how full the batch is that is open when it begins: a number up to the size of a batch.  Each span tells its answer to all of these at once, the answers of
the spans are followed one after another (a row per span), and then every span knows how it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Seconds of a span, which bounds what one is told about.
SPAN = 30 * 86400


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
    """Rows sorted by block and second → one block after another: its number, seconds, counts, and the other columns' first values."""
    block, parts, more = None, [], {}

    def whole():
        seconds, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        return block, seconds, counts, more

    for batch in batches:
        numbers = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if block != numbers[a]:
                if parts:
                    yield whole()
                block, parts = int(numbers[a]), []
                more = {n: batch.column(n)[a].as_py() for n in batch.schema.names if n not in ("block", "uts", "n")}
            parts.append((batch.column("uts").to_numpy()[a:b], batch.column("n").to_numpy()[a:b]))
    if parts:
        yield whole()


def _full(counts: np.ndarray, hint: int) -> tuple[np.ndarray, np.ndarray]:
    """Running counts, and for a batch that begins at each second the second that fills it (their number if none does)."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    return upto, np.searchsorted(upto[1:], upto[:-1] + hint)


def _answers(hint: int):
    """For each number of plays in the open batch (``hint``: full) when a span begins: that number when it ends, and how many batches begin in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, seconds, counts, _ in _blocks(batches):
            m = len(seconds)
            upto, fills = _full(counts, hint)
            ends, begins = [0] * (m + 1), [0] * (m + 1)
            for i in range(m - 1, -1, -1):
                j = int(fills[i])
                ends[i], begins[i] = (ends[j + 1], begins[j + 1] + 1) if j < m - 1 else (hint if j == m - 1 else int(upto[m] - upto[i]), 0)
            first = np.searchsorted(upto[1:], hint - np.arange(hint))  # where an open batch becomes full
            after, made = np.zeros(hint + 1, np.int64), np.zeros(hint + 1, np.int64)
            after[hint], made[hint] = ends[0], begins[0] + 1
            for held, j in enumerate(first.tolist()):
                after[held], made[held] = (ends[j + 1], begins[j + 1] + 1) if j < m - 1 else (hint if j == m - 1 else held + int(upto[m]), 0)
            yield pa.RecordBatch.from_pydict({"block": [block], "last": [int(seconds[-1])], "after": [after.tobytes()], "made": [made.tobytes()]})

    return run


def _cutting(hint: int):
    """Spans with how they begin → their parts of batches: batch, where it begins (if it does so here), its last second, its plays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, seconds, counts, told in _blocks(batches):
            upto, fills = _full(counts, hint)
            m, batch, rows, at, begins = len(seconds), told["batch"], [], 0, None
            held, before = told["held"], told["before"]
            if held == hint:
                batch, held, begins = batch + 1, 0, before + 1
            while at < m:
                j = int(fills[at]) if not held else int(np.searchsorted(upto[1:], hint - held))
                last = min(j, m - 1)
                rows.append((batch, begins, int(seconds[last]), int(upto[last + 1] - upto[at])))
                at, held, batch, begins = last + 1, 0, batch + 1, int(seconds[last]) + 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["batch", "claim_start", "last", "n"])

    return run


def tiles(seconds: DataFrame, start: int, end: int, hint: int, span: int = SPAN) -> DataFrame:
    """Counted seconds (uts, n; each once) → batches that tile [start, end): batch, claim_start, claim_end, n.

    ``seconds`` is read twice; give a written table.
    """
    spark = seconds.sparkSession
    rows = seconds.select(F.floor(F.col("uts") / span).cast("long").alias("block"), F.col("uts").cast("long"), F.col("n").cast("long"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "uts")
    answers = dealt.mapInArrow(_answers(hint), "block long, last long, after binary, made binary").orderBy("block")
    held, batch, before, begins = 0, 0, start - 1, []
    for row in answers.toLocalIterator():  # one row per span
        begins.append((row["block"], held, batch, before))
        after, made = np.frombuffer(row["after"], np.int64), np.frombuffer(row["made"], np.int64)
        batch, held, before = batch + int(made[held]), int(after[held]), row["last"]
    if not begins:
        return spark.createDataFrame([(0, start, end, 0)], "batch long, claim_start long, claim_end long, n long")
    known = spark.createDataFrame(begins, "block long, held long, batch long, before long")
    told = rows.join(F.broadcast(known), "block").repartition("block").sortWithinPartitions("block", "uts")
    parts = told.select("block", "uts", "n", "held", "batch", "before").mapInArrow(_cutting(hint), "batch long, claim_start long, last long, n long")
    whole = parts.groupBy("batch").agg(F.min("claim_start").alias("claim_start"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select("batch", F.coalesce("claim_start", F.lit(start)).cast("long").alias("claim_start"), F.when(F.col("batch") == batch, end).otherwise(F.col("last") + 1).cast("long").alias("claim_end"), "n")
