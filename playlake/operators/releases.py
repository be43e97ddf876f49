"""Ranking of catalogue releases, and similarity of names."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.operators import gap_rule

# Words that mark editions in titles and in disambiguations, secondary types of compilations, priorities.
TITLE_EDITIONS = ("deluxe", "remaster", "special", "anniversary", "expanded", "collector", "limited", "super", "bonus")
DISAMBIGUATION_EDITIONS = ("deluxe", "legacy", "expanded", "anniversary", "special", "bonus")
CATALOGUE_EDITIONS = ("deluxe", "remaster", "expanded", "anniversary")
DEMO = ("demo",)
COMPILATION_TYPES = ("Compilation", "Soundtrack", "Live", "Remix", "DJ-mix", "Mixtape/Street", "Interview")
STATUS_PRIORITY = {"Official": 0, "Promotion": 2, "Bootleg": 3, "Pseudo-Release": 4}
TYPE_PRIORITY = {"Album": 0, "EP": 1, "Single": 2, "Broadcast": 3}
VARIOUS = ("various artists", "various", "va", "v/a")
UNOFFICIAL = ("Bootleg", "Pseudo-Release")


def _any_word(text: Column, words) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return functools.reduce(Column.__or__, [low.contains(w) for w in words])


def special_title(title: Column) -> Column:
    return _any_word(title, TITLE_EDITIONS)


def special_edition(disambiguation: Column) -> Column:
    return _any_word(disambiguation, DISAMBIGUATION_EDITIONS)


def catalogue_edition(disambiguation: Column) -> Column:
    """The catalogue client's own test of special editions, with a list of its own."""
    return _any_word(disambiguation, CATALOGUE_EDITIONS)


def unofficial(status: Column) -> Column:
    """Whether a status is one that album searches leave out; a missing one isn't."""
    return F.coalesce(status.isin(*UNOFFICIAL), F.lit(False))


def eligible(credits: Column, status: Column, official_only: bool = False) -> Column:
    """Whether a release may be ranked: not by various artists and, if asked, official or without a status."""
    fine = ~F.coalesce(various_artists(credits), F.lit(False))
    return fine & F.coalesce(status == "Official", F.lit(True)) if official_only else fine


def is_demo(disambiguation: Column) -> Column:
    return _any_word(disambiguation, DEMO)


def excluded(disambiguation: Column, country: Column, terms=(), countries=(), demos: bool = True, editions: bool = True) -> Column:
    """Whether filters drop a release; a missing disambiguation or country is never a reason."""
    out = F.lit(False)
    if demos:
        out = out | is_demo(disambiguation)
    if editions:
        out = out | special_edition(disambiguation)
    if terms:
        out = out | _any_word(disambiguation, [t.lower() for t in terms])
    if countries:
        out = out | F.coalesce(F.upper(country).isin([c.upper() for c in countries]), F.lit(False))
    return out


def release_year(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4)).try_cast("int")


def various_artists(credits: Column) -> Column:
    return F.exists(credits, lambda c: F.lower(c).isin(*VARIOUS))


def is_compilation(credits: Column, secondary: Column) -> Column:
    return various_artists(credits) | F.arrays_overlap(F.coalesce(secondary, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in COMPILATION_TYPES]))


def _priority(value: Column, table: dict[str, int], missing: int, other: int) -> Column:
    out = F.when(value.isNull(), missing)
    for name, rank in table.items():
        out = out.when(value == name, rank)
    return out.otherwise(other)


def status_priority(status: Column) -> Column:
    return _priority(status, STATUS_PRIORITY, 1, 5)


def type_priority(primary: Column) -> Column:
    return _priority(primary, TYPE_PRIORITY, 4, 4)


def canonical_release(releases: DataFrame, keys: list[str], prefer_non_japanese: bool = True, **filters) -> DataFrame:
    """The release that stands for each key: id, title, date, country, disambiguation, pos (order of arrival).

    Excluded ones count only where all are.  Of those within a year of the earliest: regular editions first, among them other
    countries before Japan, the United States before the rest, then by year and arrival.
    """
    w = Window.partitionBy(*keys)
    year_text = F.when(F.col("date").isNotNull(), F.when(F.length("date") >= 4, F.substring("date", 1, 4)).otherwise("9999"))
    rows = releases.withColumns({"__out": excluded(F.col("disambiguation"), F.col("country"), **filters), "__year": year_text})
    rows = rows.withColumn("__all_out", F.min("__out").over(w)).filter(~F.col("__out") | F.col("__all_out"))
    number = F.coalesce(F.expr("try_cast(__year as int)"), F.lit(9999))
    rows = rows.withColumn("__number", number).withColumn("__first", F.first("__number").over(w.orderBy(F.col("__year").asc_nulls_last(), "pos")))
    rows = rows.filter(F.abs(F.col("__number") - F.col("__first")) <= 1)
    special, jp, us = special_edition(F.col("disambiguation")), F.coalesce(F.col("country") == "JP", F.lit(False)), F.coalesce(F.col("country") == "US", F.lit(False))
    # Among special editions alone neither country counts.
    order = [special, *([F.when(~special, jp).otherwise(False)] if prefer_non_japanese else []), F.when(~special, ~us).otherwise(False), F.col("__year").asc_nulls_last(), F.col("pos")]
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy(*order)))
    return rows.filter("__n = 1").drop("__n", "__out", "__all_out", "__year", "__number", "__first")


def matching_release(releases: DataFrame, keys: list[str], album: str, prefer_non_japanese: bool = True) -> DataFrame:
    """Of each key's releases titled ``album`` (whatever the case) the earliest, regular editions and other countries than Japan first."""
    special, jp = special_edition(F.col("disambiguation")), F.coalesce(F.col("country") == "JP", F.lit(False))
    year = F.when(F.col("date").isNotNull(), F.coalesce(F.substring("date", 1, 4), F.lit("9999")))
    order = [special, *([F.when(~special, jp).otherwise(False)] if prefer_non_japanese else []), year.asc_nulls_last(), F.col("pos")]
    rows = releases.filter(F.lower("title") == F.lower(F.col(album)))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def best_release(releases: DataFrame, keys: list[str], album: str | None = None, prefer_non_japanese: bool = True) -> DataFrame:
    """The release to take for each key: the one that :func:`matching_release` picks where a title is that of the column ``album``, else the earliest, other countries than Japan first."""
    special, jp = special_edition(F.col("disambiguation")), F.coalesce(F.col("country") == "JP", F.lit(False))
    own = F.coalesce(F.lower("title") == F.lower(F.col(album)), F.lit(False)) if album else F.lit(False)
    year = F.when(F.col("date").isNotNull(), F.when(F.length("date") >= 4, F.substring("date", 1, 4)).otherwise("9999"))
    japan = F.when(own & special, False).otherwise(jp) if prefer_non_japanese else F.lit(False)
    order = [own.desc(), (own & special), japan, year.asc_nulls_last(), F.col("pos")]
    return releases.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def rank_reason() -> Column:
    """Why a release stands where it does, in words: status, kind, edition, year."""
    comp = is_compilation(F.col("artist_credit"), F.col("secondary_types"))
    return F.concat_ws(", ", F.lower(F.coalesce("status", F.lit("no status"))), F.when(comp, "compilation").otherwise("no compilation"), F.when(special_title(F.col("title")), "special edition").otherwise("regular edition"), F.lower(F.coalesce("primary_type", F.lit("unknown type"))), F.coalesce(release_year(F.col("date")).cast("string"), F.lit("no year")))


def _head(comp: Column) -> Column:
    """Status, compilation and edition, in this order, as one number; an unknown compilation comes before others, as null does."""
    return (status_priority(F.col("status")) * 3 + F.coalesce(comp.cast("int") + 1, F.lit(0))) * 2 + special_title(F.col("title")).cast("int")


def _each_once(releases: DataFrame, keys: list[str]) -> DataFrame:
    return releases.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("pos"))).filter("__n = 1").drop("__n")


def ranked(releases: DataFrame, keys: list[str]) -> DataFrame:
    """Releases with ``rank`` from 1 by status, compilation, edition, type, year, arrival.

    The rule that an early single precedes a late album isn't transitive; :func:`ranked_with_gap` has it.
    """
    # What decides is worked out before rows are sorted, as two numbers: a caller that needs no more sorts narrow rows.
    place = _head(is_compilation(F.col("artist_credit"), F.col("secondary_types"))) * 5 + type_priority(F.col("primary_type"))
    unique = _each_once(releases.withColumns({"__place": place, "__year": release_year(F.col("date"))}), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__place", F.col("__year").asc_nulls_last(), "pos"))
    return unique.withColumn("rank", rank.cast("long")).drop("__place", "__year")


def ranked_with_gap(releases: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Each key's releases, each id once, ordered with the rule that a single ten years older than an album precedes it.

    The rule isn't transitive, so the order depends on which releases are compared: they come by status and arrival, and each is put behind the last one that
    it doesn't precede.  ``most``: only the first so many of a key by status, as the source's catalogue look-up takes 20; without it all of them.
    Missing credits make no compilation, a missing year is the last.

    Status, compilation and edition come before the rule, so where no single of the same ones is ten years older than an album, the order is that of type, year and
    arrival; the others are ordered by :mod:`playlake.operators.gap_rule`.  A key's releases are sorted in one task, on disk if need be.
    """
    comp = F.coalesce(is_compilation(F.col("artist_credit"), F.col("secondary_types")), F.lit(False))
    kind = F.when(F.col("primary_type") == "Single", 1).when(F.col("primary_type") == "Album", 2).otherwise(0)
    year = F.coalesce(release_year(F.col("date")), F.lit(gap_rule.UNKNOWN_YEAR))
    rows = releases.withColumns({"__s": status_priority(F.col("status")), "__h": _head(comp), "__t": type_priority(F.col("primary_type")), "__y": year, "__k": kind})
    rows = _each_once(rows.select(*keys, "id", "title", "pos", "__s", "__h", "__t", "__y", "__k"), keys)
    if most is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__s", "pos"))).filter(F.col("__n") <= most)
    return gap_rule.ranked(rows.drop("__s", "__n"), keys).select(*keys, "id", "title", "rank")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names whatever the case; else the share of a's characters that b has, less half of the difference of lengths in bytes, both over the greater length."""
    la, lb = F.lower(a), F.lower(b)
    common = F.size(F.filter(F.split(la, ""), lambda c: (c != "") & F.contains(lb, c)))
    longer = F.greatest(F.octet_length(la), F.octet_length(lb))
    return F.when(la == lb, 1.0).when(longer == 0, 0.0).otherwise(common / longer - 0.5 * F.abs(F.octet_length(la) - F.octet_length(lb)) / longer)


def confidence(artist: Column, found_artist: Column, title: Column, found_title: Column) -> Column:
    return (similarity(artist, found_artist) + similarity(title, found_title)) / 2


def best_matches(candidates: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Of each key's candidates (confidence, pos) the surest that reaches the threshold."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "pos")
    return candidates.filter(F.col("confidence") >= threshold).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def replacement(releases: DataFrame, keys: list[str], album: str) -> DataFrame:
    """The release that a play should move to: none where its album is there and no compilation, else the first by rank that is neither its album nor a compilation."""
    own, comp = F.lower("title") == F.lower(F.col(album)), is_compilation(F.col("artist_credit"), F.col("secondary_types"))
    rows = ranked(releases.withColumns({"__fine": own & ~comp, "__other": ~own & ~comp}), keys)
    each = Window.partitionBy(*keys)
    # Ranks differ within a key, so the least one names the row; both come from one pass over rows that are sorted by key already.
    rows = rows.withColumns({"__fine": F.max("__fine").over(each), "__least": F.min(F.when(F.col("__other"), F.col("rank"))).over(each)})
    return rows.filter(~F.col("__fine") & F.col("__other") & (F.col("rank") == F.col("__least"))).drop("__fine", "__other", "__least")


def track_exists(tracks: DataFrame, releases: DataFrame, contents: DataFrame, recordings: DataFrame, **filters) -> DataFrame:
    """Whether the catalogue has each track (id, artist, title, album?): id, exists.

    With an album: whether the release that stands for it (releases: artist, title, id and what :func:`canonical_release` reads)
    has a track of that title (contents: release_id, title).  Without: whether a recording (artist, title) has these names.
    Case doesn't count.
    """
    low = lambda c: F.lower(F.col(c))
    wanted = tracks.select(F.col("id").alias("t_id"), low("artist").alias("t_artist"), low("title").alias("t_title"), low("album").alias("t_album"))
    held = releases.withColumns({"__artist": low("artist"), "__album": low("title")})
    pairs = wanted.filter("t_album is not null").select("t_artist", "t_album").distinct()
    held = held.join(pairs, (F.col("__artist") == F.col("t_artist")) & (F.col("__album") == F.col("t_album"))).drop("__artist", "__album")
    chosen = canonical_release(held, ["t_artist", "t_album"], **filters).select("t_artist", "t_album", F.col("id").alias("release_id"))
    on_album = chosen.join(contents.select("release_id", low("title").alias("t_title")).distinct(), "release_id").select("t_artist", "t_album", "t_title")
    alone = recordings.select(low("artist").alias("t_artist"), F.lit(None).cast("string").alias("t_album"), low("title").alias("t_title")).distinct()
    known = on_album.unionByName(alone).withColumnsRenamed({c: f"k_{c}" for c in ("t_artist", "t_album", "t_title")})
    same = (F.col("t_artist") == F.col("k_t_artist")) & F.col("t_album").eqNullSafe(F.col("k_t_album")) & (F.col("t_title") == F.col("k_t_title"))
    return wanted.join(known, same, "left").select(F.col("t_id").alias("id"), F.col("k_t_title").isNotNull().alias("exists"))


def corrections(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """Tracks (id, artist, name, album?) and their catalogue matches (id, m_artist, m_title, m_album?) → id, kind, new_artist, new_track, new_album, confirm.

    Names are compared without space around them; no difference is ``no_action``.  Such edits need no confirmation.
    """
    differs = lambda a, b: F.coalesce(F.trim(a) != F.trim(b), F.lit(False))
    artist, title, album = differs("artist", "m_artist"), differs("name", "m_title"), differs("album", "m_album")
    edit = artist | title | album
    return tracks.join(matches, "id").select(
        "id", F.when(edit, "edit").otherwise("no_action").alias("kind"), F.when(artist, F.col("m_artist")).otherwise(F.col("artist")).alias("new_artist"),
        F.when(title, F.col("m_title")).otherwise(F.col("name")).alias("new_track"), F.coalesce("m_album", "album", F.lit("")).alias("new_album"), F.lit(False).alias("confirm"),
    )


def off_compilations(releases: DataFrame, keys: list[str], album: str) -> DataFrame:
    """Suggestions to move plays from compilations to their own releases: keys, new_album, confirm (always).  Plays without an album get none."""
    found = replacement(releases.filter(F.col(album).isNotNull()), keys, album)
    return found.filter(F.col("title") != F.col(album)).select(*keys, F.col("title").alias("new_album"), F.lit(True).alias("confirm"))


def albums_named(releases: DataFrame, keys: list[str], artist: str, album: str, threshold: float) -> DataFrame:
    """Releases like a wanted artist and album (columns of ``releases``), the surest first: keys, place, release_id, found_artist, title, confidence.

    Bootlegs and pseudo-releases are left out.  Of neighbours in that order with the same names the first stays; equal names
    apart from each other both do.
    """
    first = F.try_element_at("artist_credit", F.lit(1))
    sure = (F.coalesce(similarity(first, F.col(artist)), F.lit(0.0)) + similarity(F.col("title"), F.col(album))) / 2
    rows = releases.filter(~unofficial(F.col("status"))).withColumns({"confidence": sure, "found_artist": F.coalesce(first, F.col(artist))}).filter(F.col("confidence") >= threshold)
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "pos")
    names = F.struct("title", "found_artist")
    kept = rows.withColumn("__same", F.coalesce(F.lag(names).over(order) == names, F.lit(False))).filter(~F.col("__same"))
    return kept.select(*keys, (F.row_number().over(order) - 1).alias("place"), F.col("id").alias("release_id"), "found_artist", "title", "confidence")
