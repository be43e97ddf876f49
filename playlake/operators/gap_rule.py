"""The order of releases where an old single precedes a late album, without comparing each with all.

Releases of one key and head (status, compilation, edition) come one by one, and each is put behind the last one that it doesn't precede.  Albums of a known year and
singles have a common order, by year, where a single counts as ten years younger; only what stands between them by type (EPs and albums without
a year) makes circles: it follows all albums and precedes all singles.  So the row of releases is blocks of albums and singles, each in the common order and each
followed by some of the others: a new block begins when one of the others arrives while an album stands behind those that came before; the albums and singles
up to the last such album are then closed.  An album goes to the last block with a single that it follows.  With the blocks known, the order is a sort.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from playlake.shipping import ship

ALBUM, SINGLE, BETWEEN = 0, 1, 2
UNKNOWN_YEAR = 1_000_000_000
_CHUNK = 1 << 16


def blocks_of(first: np.ndarray, kind: np.ndarray, year: np.ndarray) -> np.ndarray:
    """The block of each release, of groups one after the other, in order of arrival; ``first`` marks where a group begins, years are places in the common order."""
    found, held = np.zeros(len(kind), np.int64), {}
    tail, last, waiting, least, numbers = 0, None, [], [], []  # the open block, its last album, its singles' places; of closed blocks the first single and the number
    for at in range(0, len(kind), _CHUNK):
        for i, (new, k, v) in enumerate(zip(*(c[at : at + _CHUNK].tolist() for c in (first, kind, year)), strict=True), at):
            if new:
                for own in held.values():
                    found[own] = tail
                tail, last, waiting, held, least, numbers = 0, None, [], {}, [], []
            if k == SINGLE:  # its block is known when that is closed
                if v not in held:
                    heappush(waiting, v)
                    held[v] = array("q")
                held[v].append(i)
            elif k == ALBUM:
                if tail == 0 or (waiting and waiting[0] < v):
                    found[i], last = tail, v if last is None else max(last, v)
                elif n := bisect_left(least, v):
                    found[i] = numbers[n - 1]
            elif tail == 0 or last is not None:
                if tail:  # closed blocks that a later one hides are forgotten
                    while least and least[-1] >= waiting[0]:
                        least.pop(), numbers.pop()
                    least.append(waiting[0]), numbers.append(tail)
                while last is not None and waiting and waiting[0] < last:
                    found[held.pop(heappop(waiting))] = tail
                found[i], tail, last = tail, tail + 1, None
            else:
                found[i] = tail - 1
    for own in held.values():
        found[own] = tail
    return found


def _places(rows: pa.Table) -> pa.Array:
    """The place of each release in its group, from 1; null where ``__n``, its number there without the rule, is null."""
    n = rows["__n"].fill_null(0).to_numpy()
    inside = np.flatnonzero(n)
    out = np.zeros(len(n), np.int64)
    if len(inside):
        rows = rows.select(["__kind", "__place", "pos", "id"]).take(pa.array(inside)).append_column("group", pa.array(np.cumsum(n[inside] == 1)))
        arrived = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("group", "pos", "id")], null_placement="at_start").to_numpy()
        group, kind, place = (rows[c].to_numpy()[arrived] for c in ("group", "__kind", "__place"))
        first = np.diff(group, prepend=0) > 0
        order = np.lexsort((place, kind == BETWEEN, blocks_of(first, kind, place), group))  # stable, so what is equal stays as it arrived
        begins = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))  # groups are where they were
        out[inside[arrived[order]]] = np.arange(len(first)) - begins + 1
    return pa.array(out, mask=n == 0)


def _reordering(names: list[str]):
    """Releases, sorted by group → the same with ``rank`` by the rule; only an open group waits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            # A row outside all groups, or a group's first one: what is before it is whole.
            border = np.flatnonzero(batch.column("__n").fill_null(0).to_numpy() <= 1)
            if len(border):
                yield from whole([*waiting, batch.slice(0, border[-1])])
                waiting, batch = [], batch.slice(border[-1])
            waiting.append(batch)
        if waiting:
            yield from whole(waiting)

    def whole(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        if rows["__n"].null_count < len(rows):
            moved = pc.add(pc.subtract(rows["rank"], rows["__n"]), _places(rows))
            k = rows.schema.get_field_index("rank")
            rows = rows.set_column(k, rows.schema.field(k), pc.coalesce(moved, rows["rank"]))  # the field as it was, whether it may be null included
        yield from rows.select(names).to_batches()

    return run


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Releases (``__h``: head; ``__t``: type; ``__k`` 1: single, 2: album; ``__y``: year; pos, id, title) → keys, id, title and ``rank`` by head, then by the rule within it.

    Rows are sorted once; those of heads where no single is ten years older than an album keep that order, and so do those that stand behind singles by type.
    The others of a head meet in a Python worker, which holds those of one head at a time.
    """
    ship(rows.sparkSession)
    group, order, names = [*keys, "__h"], ["__t", "__y", "pos", "id"], [*keys, "id", "title", "rank"]
    own = Window.partitionBy(*group)
    year = lambda kind: F.when((F.col("__k") == kind) & (F.col("__y") < UNKNOWN_YEAR), F.col("__y"))
    inside = (F.min(year(1)).over(own) + 10 <= F.max(year(2)).over(own)) & (F.col("__t") <= 2)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", *order)).cast("long"))
    rows = rows.withColumns({"__n": F.row_number().over(own.orderBy(*order)).cast("long"), "__inside": inside}).sortWithinPartitions(*group, *order)
    y = F.col("__y").cast("long")
    kind = F.when(F.col("__k") == 1, SINGLE).when((F.col("__k") == 2) & (y < UNKNOWN_YEAR), ALBUM).otherwise(BETWEEN)
    # A single counts as ten years younger, and precedes an album of the year that this gives.
    place = F.when(kind == ALBUM, 2 * y).when(kind == SINGLE, 2 * (y + 10) - 1).otherwise(F.col("__t") * 2 * UNKNOWN_YEAR + y)
    told = [F.when(F.col("__inside"), c).alias(n) for n, c in (("__n", F.col("__n")), ("__kind", kind), ("__place", place), ("pos", F.col("pos")))]
    return rows.select(*names, *told).mapInArrow(_reordering(names), rows.select(*names).schema)
