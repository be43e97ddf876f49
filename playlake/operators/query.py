"""Ranked, searched and paged queries over live plays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.sources.plays import in_range


def _top(plays: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return plays.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(limit)


def top_artists(plays: DataFrame, limit: int) -> DataFrame:
    return _top(plays, ["artist"], limit)


def top_tracks(plays: DataFrame, limit: int, artist: str | None = None) -> DataFrame:
    return _top(plays if artist is None else plays.filter(F.col("artist") == artist), ["artist", "track"], limit)


def has_album() -> Column:
    return F.col("album").isNotNull() & (F.col("album") != "")


def top_albums(plays: DataFrame, limit: int, artist: str | None = None) -> DataFrame:
    plays = plays.filter(has_album())
    return _top(plays if artist is None else plays.filter(F.col("artist") == artist), ["artist", "album"], limit)


def play_count(plays: DataFrame) -> DataFrame:
    return plays.agg(F.count(F.lit(1)).alias("n"))


def artist_plays(plays: DataFrame, artist: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """An artist's plays of a half-open range in order of time."""
    return in_range(plays, start, end).filter(F.col("artist") == artist).orderBy("uts", "id")


def album_plays(plays: DataFrame, album: str) -> DataFrame:
    """Plays of an album by its very name; plays without one are of none."""
    return plays.filter(F.col("album") == album)


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of an ordered listing; 0: all."""
    return rows.limit(limit) if limit else rows


def pages_between(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of pages ``first`` to ``last``, both in: what a deletion by pages picks."""
    return rows.filter(F.col("page_number").between(first, last))


def latest_first(states: DataFrame, limit: int = 0) -> DataFrame:
    """Folded states by their last change, the latest first; of equal times by id."""
    return limited(states.orderBy(F.desc("updated_at"), "id"), limit)


def before(cursor: tuple[int, str] | None) -> Column:
    """Rows behind a cursor (uts, id) in descending order."""
    if cursor is None:
        return F.lit(True)
    return (F.col("uts") < cursor[0]) | ((F.col("uts") == cursor[0]) & (F.col("id") < cursor[1]))


def recent(plays: DataFrame, limit: int, cursor: tuple[int, str] | None = None) -> DataFrame:
    """A page of the newest plays; the last row's (uts, id) is the next page's cursor."""
    return plays.filter(before(cursor)).orderBy(F.desc("uts"), F.desc("id")).limit(limit)


def matches(query: str) -> Column:
    """All words of a query, each in artist, track or album, whatever the case; an empty query matches everything."""
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("artist", "track", "album")]
    each = [reduce(Column.__or__, [f.contains(term) for f in fields]) for term in query.lower().split()]
    return reduce(Column.__and__, each, F.lit(True))


def search_recent(plays: DataFrame, query: str, limit: int, cursor: tuple[int, str] | None = None) -> DataFrame:
    return recent(plays.filter(matches(query)), limit, cursor)


def search_groups(plays: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """Matching plays by (artist, track, album), the latest group first."""
    groups = plays.filter(matches(query)).groupBy("artist", "track", "album").agg(F.count(F.lit(1)).alias("n"), F.min("uts").alias("first_uts"), F.max("uts").alias("latest_uts"))
    ordered = groups.orderBy(F.desc("latest_uts"), F.lower("artist"), F.lower("track"), F.lower("album").asc_nulls_first(), "artist", "track", F.col("album").asc_nulls_first())
    return ordered.offset(offset).limit(limit)


def rolling(plays: DataFrame, now: int, days: int | None) -> DataFrame:
    """The last days before ``now``; None: all."""
    return plays if days is None else plays.filter((F.col("uts") >= now - days * 86400) & (F.col("uts") < now))


def store_status(plays: DataFrame, coverage: DataFrame, now: int, edits: DataFrame | None = None) -> DataFrame:
    """One row: plays, oldest, newest, segments, covered seconds, staleness; of folded ``edits`` how many, and how many are pending."""
    a = plays.agg(F.count(F.lit(1)).alias("n"), F.min("uts").alias("oldest"), F.max("uts").alias("newest"))
    b = coverage.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered"), F.max("end").alias("frontier"))
    one = a.crossJoin(b).withColumn("stale_seconds", F.lit(now) - F.col("frontier"))  # one row each
    return one if edits is None else one.crossJoin(edits.agg(F.count(F.lit(1)).alias("edits"), F.count_if(F.col("state") == "pending").alias("pending")))


def library(plays: DataFrame, limit: int, coverage: DataFrame | None = None, artist: str | None = None) -> DataFrame:
    """Dashboard rows (kind, artist, name, n): totals, top artists, top albums.

    With ``coverage`` also where it begins and ends and how many seconds it has; with ``artist`` also that artist's top tracks and albums.
    """
    def kind(df, name, artist, of):
        return df.select(F.lit(name).alias("kind"), artist.alias("artist"), of.alias("name"), "n")

    nothing = F.lit(None).cast("string")
    rows = (
        kind(play_count(plays), "total", nothing, nothing)
        .unionByName(kind(plays.agg(F.max("uts").alias("n")), "latest", nothing, nothing))
        .unionByName(kind(top_artists(plays, limit), "artist", F.col("artist"), nothing))
        .unionByName(kind(top_albums(plays, limit), "album", F.col("artist"), F.col("album")))
    )
    if coverage is not None:
        facts = coverage.agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered"))
        rows = rows.unionByName(facts.select(F.stack(F.lit(3), *[x for c in ("span_start", "span_end", "covered") for x in (F.lit(c), F.col(c))]).alias("kind", "n")).select("kind", nothing.alias("artist"), nothing.alias("name"), "n"))
    if artist is not None:
        rows = rows.unionByName(kind(top_tracks(plays, limit, artist), "drill_track", F.col("artist"), F.col("track"))).unionByName(kind(top_albums(plays, limit, artist), "drill_album", F.col("artist"), F.col("album")))
    return rows


def album_sections(plays: DataFrame) -> DataFrame:
    """Tracks by album with running numbers: artist, album, track, album_no, track_no, n."""
    tracks = plays.filter(has_album()).groupBy("artist", "album", "track").agg(F.count(F.lit(1)).alias("n"))
    return tracks.withColumns({
        "album_no": F.dense_rank().over(Window.partitionBy("artist").orderBy("album")).cast("long"),
        "track_no": F.row_number().over(Window.partitionBy("artist", "album").orderBy(F.desc("n"), "track")).cast("long"),
    })


def offset_range(plays: DataFrame, first: int, last: int) -> DataFrame:
    """The plays at places ``first`` to ``last`` (from 0, both in) of the newest-first order, by a bounded top-k and no global sort."""
    return plays.orderBy(F.desc("uts"), F.desc("id")).limit(last + 1).offset(first)


def between_times(plays: DataFrame, first: int, last: int) -> DataFrame:
    """Plays between two times, both in: what a deletion by range picks."""
    return plays.filter(F.col("uts").between(first, last))


def first_match(plays: DataFrame, artist: str, track: str) -> DataFrame:
    return recent(plays.filter((F.col("artist") == artist) & (F.col("track") == track)), 1)
