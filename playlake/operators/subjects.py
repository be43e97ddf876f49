"""Subjects: what plays have in common that a clean-up may change; and the joins on them, all null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("artist", "track", "album", "album_artist")


def subject_columns(plays: DataFrame) -> DataFrame:
    """Plays with ``subject_aa``: the album artist, only where it is verified."""
    return plays.withColumn("subject_aa", F.when(F.col("album_artist.state") == "verified", F.col("album_artist.value")))


def group_by_subject(plays: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per subject: its key, n (plays), latest_uts; ``with_ids``: the ids too, which gather in one row."""
    more = [F.sort_array(F.collect_list("id")).alias("ids")] if with_ids else []
    rows = subject_columns(plays) if dict(plays.dtypes).get("album_artist", "").startswith("struct") else plays.withColumn("subject_aa", F.lit(None).cast("string"))
    return rows.groupBy("artist", "track", "album", F.col("subject_aa").alias("album_artist")).agg(F.count(F.lit(1)).alias("n"), F.max("uts").alias("latest_uts"), *more)


def same_subject(left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in KEY])


def without(subjects: DataFrame, *others: DataFrame) -> DataFrame:
    """Subjects that are in none of the others, such as dismissed or open ones."""
    for other in others:
        subjects = subjects.join(other, same_subject(subjects, other), "left_anti")
    return subjects


def expand(subjects: DataFrame, plays: DataFrame) -> DataFrame:
    """Each subject's live plays: same artist and track, same album or none on both, and the album artist if it is pinned."""
    held = plays.select("id", "uts", F.col("artist").alias("p_artist"), F.col("track").alias("p_track"), F.col("album").alias("p_album"), F.col("album_artist.value").alias("p_aa"))
    cond = (F.col("artist") == F.col("p_artist")) & (F.col("track") == F.col("p_track")) & F.col("album").eqNullSafe(F.col("p_album")) & (F.col("album_artist").isNull() | (F.col("album_artist") == F.col("p_aa")))
    return subjects.join(held, cond).drop("p_artist", "p_track", "p_album", "p_aa")


def first_suggestions(suggestions: DataFrame) -> DataFrame:
    """Of each subject the edit of the first provider that has one: columns KEY, provider_rank, idx, kind, …"""
    order = Window.partitionBy(*KEY).orderBy("provider_rank", "idx")
    edits = suggestions.filter(F.col("kind") == "edit")
    return edits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def combined(suggestions: DataFrame) -> DataFrame:
    """All providers' suggestions for each subject, in their order."""
    listed = F.sort_array(F.collect_list(F.struct("provider_rank", "idx", "kind", "payload")))
    return suggestions.groupBy(*KEY).agg(listed.alias("suggestions"))


def overlay(edit: DataFrame, fields=("track", "album", "artist", "album_artist")) -> DataFrame:
    """An instance's own values with what the proposal changes laid over: ``original_<f>``, ``new_<f>``, ``current_<f>`` → ``result_<f>``.

    A field is changed when original and new differ; a new null never erases.
    """
    return edit.withColumns({
        f"result_{f}": F.when(F.col(f"original_{f}").eqNullSafe(F.col(f"new_{f}")), F.col(f"current_{f}")).otherwise(F.coalesce(f"new_{f}", f"current_{f}"))
        for f in fields
    })


FIELDS = ("track", "album", "artist", "album_artist")


def _edit(original: dict[str, Column], new: dict[str, Column], timestamp: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(*[original.get(f, nothing).alias(f"original_{f}") for f in FIELDS], *[new.get(f, nothing).alias(f"new_{f}") for f in FIELDS], timestamp.cast("long").alias("timestamp"), F.lit(True).alias("edit_all"))


def no_op_edit() -> Column:
    """A play's edit that changes nothing; an unknown album artist stays unknown."""
    own = {f: F.col(f) for f in FIELDS}
    return _edit(own, own, F.col("timestamp"))


def track_edit(track: Column, artist: Column, album: Column | None = None, timestamp: Column | None = None) -> Column:
    """An edit of one track, nothing changed yet; without an album of all albums that have it.  The album artist is left open."""
    own = {"track": track, "artist": artist} | ({"album": album} if album is not None else {})
    return _edit(own, own, timestamp if timestamp is not None else F.lit(None))


def artist_edit(old: Column, new: Column) -> Column:
    """An artist's new name, on all tracks and albums, also as album artist."""
    return _edit({"artist": old}, {"artist": new, "album_artist": new}, F.lit(None))


def album_edit(album: Column, old: Column, new: Column) -> Column:
    """An album's new artist, where the old one is its album artist; album artists stay."""
    return _edit({"album": album, "artist": old, "album_artist": old}, {"album": album, "artist": new}, F.lit(None))


def with_artist(edit: Column, artist: Column) -> Column:
    """An edit with another new artist, who becomes the album artist as well."""
    return edit.withField("new_artist", artist).withField("new_album_artist", artist)


def summary_text(edit: Column) -> Column:
    """What an edit changes, in words: a track needs both names; a missing album or album artist is a dash."""
    def quoted(c):
        return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("-"))

    def part(field):
        old, new = edit[f"original_{field}"], edit[f"new_{field}"]
        differs = F.coalesce(old != new, F.lit(False)) if field == "track" else ~old.eqNullSafe(new)
        return F.when(differs, F.concat(F.lit(f"{field.replace('_', ' ')}: "), quoted(old), F.lit(" -> "), quoted(new)))

    joined = F.concat_ws("; ", *[part(f) for f in ("track", "artist", "album", "album_artist")])
    return F.when(joined == "", "no changes").otherwise(joined)


def diff_text(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """``field: old -> new`` for what differs, joined by ``; ``; ``no changes`` if nothing does."""
    parts = [F.when(~old.eqNullSafe(new) & new.isNotNull(), F.concat(F.lit(f"{name}: "), F.coalesce(old, F.lit("")), F.lit(" -> "), new)) for name, (old, new) in pairs.items()]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "no changes").otherwise(joined)
