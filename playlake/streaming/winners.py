"""Deduplication with keyed state: of each id's observations only those that win go on, over batches, repetitions and restarts.

The state of an id is when its winner was fetched and in which order it came; a row goes on if it comes after that, so what the view is merged with is small
however often the same observations arrive.  A watermark on the time of fetching bounds the state: rows fetched before it are late and left out, so every
row that still comes wins against a winner from before it, and that winner's state can go.  ``delay`` has to be at least as long as observations may be on their way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from playlake.schema import PLAY
from playlake.shipping import ship
from playlake.streaming.merge import merge_batch, stream_log

_FLAT = T.StructType([*(f for f in PLAY if f.name != "album_artist"), T.StructField("aa_state", T.StringType()), T.StructField("aa_value", T.StringType())])
_STATE = T.StructType([T.StructField("fetched_at", T.LongType()), T.StructField("seq", T.LongType())])


def _keep(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row of a batch that wins against all that came before, if there is one."""
    if state.hasTimedOut:
        state.remove()
        return
    known = tuple(state.get) if state.exists else None
    best, winner = known, None
    for frame in frames:
        order = frame[["fetched_at", "seq"]].fillna({"seq": 0})
        top = order.sort_values(["fetched_at", "seq"]).iloc[-1]
        found = (int(top["fetched_at"]), int(top["seq"]))
        if best is None or found > best:
            best, winner = found, frame.loc[[top.name]]
    state.update(best)
    state.setTimeoutTimestamp(max(best[0] * 1000, state.getCurrentWatermarkMs()) + 1)
    if winner is not None:
        out = winner[_FLAT.names].astype(object)
        yield out.where(out.notna(), None)


def winners(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Observations → those that are their ids' winners when they come, in the shape of :data:`playlake.schema.PLAY`; output mode ``update``."""
    ship(stream.sparkSession)
    flat = stream.filter("id is not null and fetched_at is not null").select(*(c for c in _FLAT.names if not c.startswith("aa_")), F.col("album_artist.state").alias("aa_state"), F.col("album_artist.value").alias("aa_value"))
    timed = flat.withColumn("fetched_time", F.timestamp_seconds("fetched_at")).withWatermark("fetched_time", delay)
    kept = timed.groupBy("id").applyInPandasWithState(_keep, _FLAT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    source = F.when(F.col("aa_state").isNotNull(), F.struct(F.col("aa_state").alias("state"), F.col("aa_value").alias("value")))
    return kept.withColumn("album_artist", source).select(*PLAY.names)


def merge_winners(spark: SparkSession, log_path: str, view_path: str, checkpoint: str, delay: str = "30 days"):
    """Merge whatever is new in a log into a view, winners only, then stop; returns the query."""
    stream = winners(stream_log(spark, log_path), delay).writeStream.outputMode("update")
    query = stream.foreachBatch(merge_batch(view_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
