"""The current view of a play log: last write wins; append, tombstones, compaction, scans and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playlake.schema import id_uts, month_of, month_text, play_id
from playlake.sources.plays import in_range

_COMPARED = ("uts", "artist", "track", "album", "fetched_at", "deleted")


def current(log: DataFrame) -> DataFrame:
    """Of each id the observation that was fetched last; of equal times the one that arrived last.

    Month and seconds follow from the id; they are among the window's keys so that filters on them reach the scan.  Other
    filters must come after this: a tombstone or a change of title has to win first.
    """
    latest = Window.partitionBy("month", "uts", "id").orderBy(F.desc("fetched_at"), F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def live(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """What is there now, in a range of seconds."""
    return in_range(current(log), start, end).filter(~F.col("deleted"))


def union_merge(*logs: DataFrame) -> DataFrame:
    """Logs of several machines as one; repeated lines fold to the same view."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def range_scan(log: DataFrame, start: int | None, end: int | None) -> DataFrame:
    return live(log, start, end).orderBy("uts", "id")


def point_lookup(log: DataFrame, play: str) -> DataFrame:
    """The row of an id, a tombstone too; its month prunes the scan."""
    head = play.split("-")[0]
    rows = log.filter(F.col("id") == play)
    if head.isdigit():
        rows = rows.filter((F.col("month") == month_text(int(head))) & (F.col("uts") == int(head)))
    return current(rows)


def latest_uts(log: DataFrame) -> DataFrame:
    return live(log).agg(F.max("uts").alias("latest_uts"))


def classify_append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with ``outcome``: new, updated, or unchanged (identical or older; such rows aren't written).

    Each row meets the log's current row and the rows before it in the batch, by ``seq``.
    """
    state = F.struct(*_COMPARED)
    held = current(log).select("id", F.col("fetched_at").alias("h_at"), state.alias("h_state"))
    earlier = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = batch.withColumn("__state", state).withColumn("__before", F.max(F.struct("fetched_at", "seq", "__state")).over(earlier)).join(held, "id", "left")
    in_batch = F.col("__before").isNotNull() & (F.col("h_at").isNull() | (F.col("__before.fetched_at") >= F.col("h_at")))
    at = F.when(in_batch, F.col("__before.fetched_at")).otherwise(F.col("h_at"))
    known = F.when(in_batch, F.col("__before.__state")).otherwise(F.col("h_state"))
    outcome = F.when(at.isNull(), "new").when((F.col("fetched_at") < at) | (F.col("__state") == known), "unchanged").otherwise("updated")
    return rows.withColumn("outcome", outcome).drop("__state", "__before", "h_at", "h_state")


def append_stats(log: DataFrame, batch: DataFrame) -> DataFrame:
    classes = classify_append(log, batch)
    return classes.agg(*[F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in ("new", "updated", "unchanged")])


def tombstones(rows: DataFrame, at: int) -> DataFrame:
    return rows.withColumns({"deleted": F.lit(True), "fetched_at": F.lit(at).cast("long")})


def compact(log: DataFrame) -> DataFrame:
    """What compaction keeps: the winner of each id, tombstones too, by seconds and id within months."""
    return current(log).repartitionByRange("month", "uts", "id").sortWithinPartitions("month", "uts", "id")


def compact_counts(log: DataFrame) -> DataFrame:
    """Per month: rows, rows that stay, rows that go.  Months with none to go needn't be rewritten."""
    counts = log.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("kept"))
    return counts.withColumn("dropped", F.col("n_rows") - F.col("kept"))


def mirror_edit(plays: DataFrame, edits: DataFrame, at: int) -> DataFrame:
    """Rows to append after an edit: each new identity, and a tombstone of the old one where it changed.

    ``edits``: id, new_artist, new_track, new_album, new_album_artist.
    """
    both = plays.join(edits, "id")
    new = both.select(
        play_id(F.col("uts"), F.col("new_artist"), F.col("new_track")).alias("id"), "uts", F.col("new_artist").alias("artist"), F.col("new_track").alias("track"),
        F.col("new_album").alias("album"), F.struct(F.lit("verified").alias("state"), F.col("new_album_artist").alias("value")).alias("album_artist"),
        F.lit("edit_mirror").alias("source"), F.lit(at).cast("long").alias("fetched_at"), F.lit(False).alias("deleted"),
    )
    changed = both.filter(F.col("id") != play_id(F.col("uts"), F.col("new_artist"), F.col("new_track")))
    old = tombstones(changed, at).select("id", "uts", "artist", "track", "album", F.lit(None).cast("struct<state:string,value:string>").alias("album_artist"), F.lit("edit_mirror").alias("source"), "fetched_at", "deleted")
    return new.unionByName(old).withColumn("month", month_of("uts"))


def ids_in_order(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The live rows of listed ids (id, place), in the list's order; unknown ids and tombstones are left out."""
    wanted = ids.withColumns({"uts": id_uts("id")})
    return live(log).join(wanted.select("id", "place"), "id").orderBy("place")
