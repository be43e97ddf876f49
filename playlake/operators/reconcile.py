"""Comparing the log with upstream: tombstones for what has gone, what edits are there already, enrichment, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.operators.store import live, tombstones


def verify(log: DataFrame, upstream: DataFrame, start: int, end: int, at: int) -> DataFrame:
    """Tombstones for live plays of the range that upstream doesn't have."""
    return tombstones(live(log, start, end).join(upstream.select("id").distinct(), "id", "left_anti"), at)


def enrich(plays: DataFrame, variations: DataFrame) -> DataFrame:
    """Album artist (and a missing album) from edit-form variations (artist, track, pos, v_album, v_album_artist): the one with the same album, else the first."""
    choice = F.struct("v_album", "v_album_artist")
    first = variations.groupBy("artist", "track").agg(F.min_by(choice, "pos").alias("__first"))
    own = variations.groupBy("artist", "track", F.col("v_album").alias("album")).agg(F.min_by(choice, "pos").alias("__own"))
    # One row for each track and one for each of its albums: a play meets one of each, so it isn't multiplied.
    best = plays.join(first, ["artist", "track"], "left").join(own, ["artist", "track", "album"], "left").withColumn("__v", F.coalesce("__own", "__first"))
    found = F.col("__v.v_album_artist").isNotNull()
    return best.select(
        "id", "artist", "track", F.when(found, F.coalesce("album", "__v.v_album")).otherwise(F.col("album")).alias("album"),
        F.col("__v.v_album_artist").alias("album_artist"), F.when(found, "scrape").otherwise("api").alias("source"),
    )


def already_applied(edits: DataFrame, upstream: DataFrame) -> DataFrame:
    """Which edits (edit_id, uts, old_*, new_*) upstream shows already: the new name at that second and not the old one."""
    held = upstream.select(F.col("uts").alias("u_uts"), "artist", "track", "album").distinct()
    for which in ("new", "old"):
        same = (F.col("uts") == F.col("u_uts")) & (F.col("artist") == F.col(f"{which}_artist")) & (F.col("track") == F.col(f"{which}_track")) & F.col("album").eqNullSafe(F.col(f"{which}_album"))
        edits = edits.join(held, same, "left").withColumn(f"{which}_there", F.col("u_uts").isNotNull()).drop("u_uts", "artist", "track", "album")
    flags = edits.groupBy("edit_id").agg(F.max("new_there").alias("new_there"), F.max("old_there").alias("old_there"))
    return flags.withColumn("applied", F.col("new_there") & ~F.col("old_there"))


def discover(edits: DataFrame, library: DataFrame) -> DataFrame:
    """Partly given edits (edit_id, artist, track?, album?, album_artist?, new_artist?, new_track?, new_album?, new_album_artist?) → the exact ones they stand for.

    What isn't given matches all of ``library`` (artist, track, album, album_artist); what isn't changed keeps its value.  An edit
    that gives track and album is exact: if nothing is there for it, it comes back with an ``error``.  A given album artist
    leaves only what has it.
    """
    names = ("artist", "track", "album", "album_artist")
    edits = edits.select("edit_id", *[F.col(c) if c in edits.columns else F.lit(None).cast("string").alias(c) for c in (*names, *[f"new_{n}" for n in names])])
    held = library.select(*[F.col(n).alias(f"l_{n}") for n in names]).distinct()
    given = {(t, a): edits.filter((F.col("track").isNotNull() == t) & (F.col("album").isNotNull() == a)) for t in (True, False) for a in (True, False)}
    found = None
    for (track, album), part in given.items():
        on = [F.col("artist") == F.col("l_artist"), *([F.col("track") == F.col("l_track")] if track else []), *([F.col("album") == F.col("l_album")] if album else [])]
        rows = part.join(held, reduce(Column.__and__, on), "left" if track and album else "inner")
        found = rows if found is None else found.unionByName(rows)
    missing = F.col("l_artist").isNull()
    found = found.filter(missing | F.col("album_artist").isNull() | (F.col("album_artist") == F.col("l_album_artist")))
    return found.select(
        "edit_id", F.col("artist").alias("original_artist"), *[F.col(f"l_{n}").alias(f"original_{n}") for n in names[1:]],
        *[F.when(~missing, F.coalesce(f"new_{n}", f"l_{n}")).alias(f"new_{n}") for n in names], F.when(missing, "no such play").alias("error"),
    )


def of_album_artist(edits: DataFrame, album_artist: str | None) -> DataFrame:
    """Discovered edits of one album artist; None: all."""
    return edits if album_artist is None else edits.filter(F.col("original_album_artist") == album_artist)


def variations(forms: DataFrame) -> DataFrame:
    """Edit forms (page, pos, artist, track, album, album_artist?) → the first of each (artist, track, album, album artist); a missing album artist is the artist."""
    filled = forms.filter(F.col("page") <= 5).withColumn("album_artist", F.coalesce("album_artist", "artist"))
    order = Window.partitionBy("artist", "track", "album", "album_artist").orderBy("page", "pos")
    return filled.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def response_summary(results: DataFrame) -> DataFrame:
    """Per edit: attempts, successes, whether all (never of none) and any succeeded, and a sentence."""
    s = results.groupBy("edit_id").agg(F.count("success").alias("n"), F.count_if(F.col("success")).alias("ok"))
    s = s.withColumns({"all_successful": (F.col("n") > 0) & (F.col("ok") == F.col("n")), "any_successful": F.col("ok") > 0})
    message = F.when(F.col("n") == 0, "nothing to do").otherwise(F.concat(F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" succeeded")))
    return s.withColumn("message", message)


def enable_defaults(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rules, and those defaults whose name isn't among them; unnamed ones always come along."""
    fresh = defaults.join(rules.select("name").filter("name is not null").distinct(), "name", "left_anti")
    return rules.unionByName(fresh)


def bulk_delete(plays: DataFrame, results: DataFrame) -> DataFrame:
    """A deletion manifest: each play's number from 1 on, the newest first, and how it went (deleted, failed, pending).

    Numbers run through, but no task sorts the whole selection: plays are numbered within days, after those of later days.
    """
    day = F.floor(F.col("uts") / 86400)
    rows = plays.withColumn("day", day)
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    offsets = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("uts"), F.desc("id")))
    numbered = rows.withColumn("number", within).join(offsets, "day").withColumn("number", (F.col("number") + F.col("before")).cast("long"))
    status = F.when(F.col("success").isNull(), "pending").when(F.col("success"), "deleted").otherwise("failed")
    return numbered.join(results, "id", "left").select("id", "uts", "number", status.alias("status"))


def delete_report(manifest: DataFrame) -> DataFrame:
    """One row: plays found, deleted, failed."""
    return manifest.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") == "failed").alias("failed"))


def verify_report(upstream: DataFrame, appended: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of a comparison: rows fetched, rows written (``outcome`` new or updated), tombstones."""
    rows = upstream.select(F.lit("upstream_count").alias("k")).unionByName(appended.filter("outcome <> 'unchanged'").select(F.lit("written").alias("k"))).unionByName(gone.select(F.lit("tombstoned").alias("k")))
    return rows.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("upstream_count", "written", "tombstoned")])
