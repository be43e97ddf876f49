"""Record schemas, ids and provenance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

LONG_MAX = (1 << 63) - 1
PROVENANCED = T.StructType([T.StructField("state", T.StringType()), T.StructField("value", T.StringType())])
#: One observation of a play; ``seq`` is its order of arrival.
PLAY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("uts", T.LongType()), T.StructField("artist", T.StringType()),
    T.StructField("track", T.StringType()), T.StructField("album", T.StringType()), T.StructField("album_artist", PROVENANCED),
    T.StructField("source", T.StringType()), T.StructField("fetched_at", T.LongType()), T.StructField("deleted", T.BooleanType()),
    T.StructField("v", T.IntegerType()), T.StructField("seq", T.LongType()),
])
COVERAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "verified_at")])


def play_id(uts, artist, track) -> Column:
    """``{uts}-{first 8 hex digits of the SHA-256 of artist, a zero byte, track}``."""
    uts, artist, track = (F.col(c) if isinstance(c, str) else c for c in (uts, artist, track))
    return F.concat(uts.cast("string"), F.lit("-"), F.substring(F.sha2(F.encode(F.concat(artist, F.lit("\0"), track), "UTF-8"), 256), 1, 8))


def id_uts(play) -> Column:
    """The seconds that an id begins with; null if it has none."""
    return F.expr(f"try_cast(substring_index({play}, '-', 1) as bigint)")


def valid_id(play) -> Column:
    return F.col(play).rlike("^[0-9]+-[0-9a-f]{8}$")


def month_of(uts) -> Column:
    """``yyyy-MM`` in UTC."""
    uts = F.col(uts) if isinstance(uts, str) else uts
    return F.date_format(F.timestamp_seconds(uts), "yyyy-MM")


def month_text(uts: int) -> str:
    """The same for a number on the driver, clamped to years that have four digits."""
    import datetime

    bounded = max(0, min(uts, 253402300799))
    return datetime.datetime.fromtimestamp(bounded, datetime.UTC).strftime("%Y-%m")


def month_bounds(month: str) -> tuple[int, int]:
    """First second of ``yyyy-MM`` and of the month after it."""
    import datetime

    year, number = map(int, month.split("-"))
    first = datetime.datetime(year, number, 1, tzinfo=datetime.UTC)
    after = datetime.datetime(year + number // 12, number % 12 + 1, 1, tzinfo=datetime.UTC)
    return int(first.timestamp()), int(after.timestamp())


def saturated(bound: int | None, default: int) -> int:
    """A range bound as a long; unsigned values beyond it count as the greatest long."""
    return default if bound is None else max(0, min(bound, LONG_MAX))


def album_artist_of(source, value) -> Column:
    """How far an album artist can be trusted: scraped ones are verified, others not; a missing one is unknown."""
    state = F.when(value.isNull(), "unknown").when(source == "scrape", "verified").otherwise("unverified")
    return F.struct(state.alias("state"), value.alias("value"))
