"""Play logs: month-partitioned files with one observation a line, tolerant of torn lines; and an adapter for event tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playlake.schema import LONG_MAX, PLAY, album_artist_of, month_of, month_text, play_id, saturated


def read_log(spark: SparkSession, path: str, unknown: bool = False) -> DataFrame:
    """All observations of a log.  Blank and torn lines are left out, wherever they stand.

    With ``unknown``, fields that the schema doesn't have are kept as they are, in a column of this name: a map of variants, null where there are none.
    """
    schema, corrupt = T.StructType([*PLAY.fields, T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"}
    if unknown:
        lines = spark.read.text(path)
        others = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin(*PLAY.names, "month"))
        rows = lines.withColumns({"unknown": F.when(F.size(others) > 0, others), "__r": F.from_json("value", schema, corrupt)}).select("__r.*", *[c for c in lines.columns if c != "value"], "unknown")
    else:
        rows = spark.read.schema(schema).options(**corrupt).json(path)
    rows = rows.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")
    found = rows.withColumns({"deleted": F.coalesce("deleted", F.lit(False)), "v": F.coalesce("v", F.lit(1)), "seq": F.coalesce("seq", F.lit(0))})
    return found if "month" in found.columns else found.withColumn("month", month_of("uts"))


def write_log(rows: DataFrame, path: str) -> None:
    """Append observations as new files, one folder for each month; files that are there never change.

    The fields of a map ``unknown``, as :func:`read_log` gives it, are written beside the others.
    """
    known = [c for c in rows.columns if c not in ("month", "unknown")]
    ordered = rows.withColumn("month", month_of("uts")).repartitionByRange("month", "uts", "id")
    if "unknown" in rows.columns:
        line, more = F.to_json(F.struct(*known)), F.to_json("unknown", {"ignoreNullFields": "false"})
        whole = F.when(F.coalesce(F.size("unknown"), F.lit(0)) > 0, F.concat(line.substr(F.lit(1), F.length(line) - 1), F.lit(","), more.substr(F.lit(2), F.length(more)))).otherwise(line)
        ordered.select(whole.alias("value"), "month").write.mode("append").partitionBy("month").text(path)
    else:
        ordered.select(*known, "month").write.mode("append").partitionBy("month").json(path)


def with_provenance(tracks: DataFrame, source: str, fetched_at: int) -> DataFrame:
    """Track rows (name, artist, album?, album_artist?, timestamp?) → observations.  What plays just now has no time and isn't one."""
    uts = F.col("timestamp").cast("long")
    return tracks.filter(F.col("timestamp").isNotNull()).select(
        play_id(uts, F.col("artist"), F.col("name")).alias("id"), uts.alias("uts"), "artist", F.col("name").alias("track"), "album",
        album_artist_of(F.lit(source), F.col("album_artist")).alias("album_artist"), F.lit(source).alias("source"),
        F.lit(fetched_at).cast("long").alias("fetched_at"), F.lit(False).alias("deleted"), F.lit(1).alias("v"),
    )


def in_range(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Half-open range of seconds; the months that it touches prune partitions."""
    lo, hi = saturated(start, 0), saturated(end, LONG_MAX)
    rows = rows.filter((F.col("uts") >= lo) & (F.col("uts") < hi))
    if "month" in rows.columns and (start is not None or end is not None):
        rows = rows.filter(F.col("month").between(month_text(lo), month_text(max(lo, hi - 1))))
    return rows


def observations(events: DataFrame) -> DataFrame:
    """An ``events`` table (event_id, ts, user_id, event_type, props) seen as a play log, hours as seconds."""
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = events.select(
        F.col("event_id").alias("seq"),
        (F.floor(seconds / 3600) * 3600).cast("long").alias("uts"),
        F.concat(F.lit("artist_"), (F.col("user_id") % 20).cast("string")).alias("artist"),
        F.concat(F.lit("track_"), (k % 10).cast("string")).alias("track"),
        F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", "").otherwise(F.concat(F.lit("album_"), (k % 5).cast("string"))).alias("album"),
        (F.lit(1704067200) + (F.col("event_id") * 7919) % 7).cast("long").alias("fetched_at"),
        (F.col("event_type") == "error").alias("deleted"),
        "event_type", "user_id", "value",
    )
    return rows.withColumns({"id": play_id("uts", "artist", "track"), "month": month_of("uts")})


