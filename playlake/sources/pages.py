"""Pages of the remote service as tables: JSON pages, HTML pages, forms, addresses."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_TRACK = "struct<name:string,artist:struct<`#text`:string>,album:struct<`#text`:string>,date:struct<uts:string>,`@attr`:struct<nowplaying:string>>"
_HEAD = "struct<page:string,totalPages:string>"


def api_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """JSON pages → page columns plus ``tracks`` (array; a page of one track may hold it bare, an empty one none), has_next, total_pages, error."""
    # The tracks are read as text first, which is an array or one object, so each body is parsed once and each text once.
    read = F.from_json(body, f"struct<recenttracks:struct<track:string,`@attr`:{_HEAD}>,error:string,message:string>")
    rows = pages.withColumn("__page", read)
    text = F.col("__page.recenttracks.track")
    listed = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    page, total = (F.coalesce(F.col(f"__page.recenttracks.@attr.{n}").try_cast("int"), F.lit(1)) for n in ("page", "totalPages"))
    code = F.col("__page.error")
    error = F.when(code.isNotNull(), F.concat_ws(": ", F.concat(F.lit("error "), code), F.col("__page.message")))
    tracks = F.coalesce(F.from_json(listed, f"array<{_TRACK}>"), F.array().cast(f"array<{_TRACK}>"))
    return rows.withColumns({"tracks": tracks, "page_number": page, "total_pages": total, "has_next": page < total, "error": error}).drop("__page")


def api_tracks(pages: DataFrame, body: str = "body", before: int | None = None) -> DataFrame:
    """One row per played track of JSON pages: page_number, place, name, artist, album, timestamp.

    What plays just now, and rows whose time can't be read, aren't plays.  ``before``: the pin that newer rows are clipped at.
    """
    rows = api_pages(pages, body).select("page_number", F.posexplode("tracks").alias("place", "t"))
    uts = F.col("t.date.uts").try_cast("long")
    playing = F.coalesce(F.col("t.@attr.nowplaying") == "true", F.lit(False))
    out = rows.filter(~playing & uts.isNotNull()).select("page_number", "place", F.col("t.name").alias("name"), F.col("t.artist.#text").alias("artist"), F.nullif(F.col("t.album.#text"), F.lit("")).alias("album"), uts.alias("timestamp"))
    return out if before is None else out.filter(F.col("timestamp") < before)


def page_bounds(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def until_stop(tracks: DataFrame, stop: int) -> DataFrame:
    """Rows of a newest-first feed before the first that isn't newer than ``stop``; as rows descend in time, that is a filter."""
    return tracks.filter(F.col("timestamp") > stop)


def links(html: Column) -> Column:
    """All addresses that a page links to, in order."""
    return F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?\bhref\s*=\s*"([^"]*)\""""), F.lit(1))


def total_pages(paginator: Column) -> Column:
    """The number of pages that a paginator tells: behind `` of ``, else the greatest page of its links; a page without one is single."""
    of = F.regexp_extract(paginator, r" of ([0-9]{1,9})", 1).try_cast("int")
    most = F.array_max(F.transform(F.regexp_extract_all(paginator, F.lit(r"page=([0-9]{1,9})"), F.lit(1)), lambda x: x.cast("int")))
    labels = F.array_max(F.transform(F.regexp_extract_all(paginator, F.lit(r">\s*([0-9]{1,9})\s*</a>"), F.lit(1)), lambda x: x.cast("int")))
    return F.when(paginator.isNull(), 1).otherwise(F.coalesce(of, F.greatest(most, labels)))


def has_next(paginator: Column) -> Column:
    return F.coalesce(paginator.rlike(r"""aria-label="Next( page)?"|rel="next"|pagination-next|>\s*Next"""), F.lit(False))


def number(text: Column) -> Column:
    """A count as pages write it: the first word, commas left out; 1 if it can't be read."""
    return F.coalesce(F.regexp_replace(F.element_at(F.split(F.trim(text), r"\s+"), 1), ",", "").try_cast("long"), F.lit(1))


def form_fields(body: Column) -> Column:
    """A URL-encoded form as a map of text; of repeated names the last counts."""
    pairs = F.filter(F.split(body, "&"), lambda p: p != "")
    part = lambda p, i: F.url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(i)), F.lit("")))
    names = F.transform(pairs, lambda p: part(p, 0))
    last = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.array_position(F.slice(names, i + 1, F.size(names)), F.element_at(names, i)) == 0)
    return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(last, lambda i: F.struct(F.element_at(names, i).alias("key"), part(F.element_at(pairs, i), 1).alias("value"))))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def form_text(fields: Column) -> Column:
    """A map as a URL-encoded form, names in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit(""))))), "&")


def api_window(start: int | None, end: int | None) -> tuple[int | None, int | None]:
    """The bounds to ask the service for: a second more at the beginning, which the store's folding absorbs."""
    return (None if start is None else max(0, start - 1)), end


def clip_to_pin(tracks: DataFrame, pin: int | None) -> DataFrame:
    """Rows before the pin; rows without a time stay, and so do those before the window's start, which show that it is complete."""
    return tracks if pin is None else tracks.filter(F.col("timestamp").isNull() | (F.col("timestamp") < pin))


def request_parts(url: Column) -> Column:
    """struct(path, query) of an address."""
    return F.struct(F.parse_url(url, F.lit("PATH")).alias("path"), form_fields(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))).alias("query"))


def edit_outcome(html: Column, status: Column) -> Column:
    """struct(success, message) of an edit's answer: an answer of 200 to 299 with a success alert and no error alert."""
    def has(names):
        return html.rlike(rf"""class="[^"]*\b(?:{names})(?![\w-])""")

    good, bad = has("alert-success"), has("alert-danger|alert-error|error")
    success = status.between(200, 299) & good & ~bad
    message = F.when(bad, "edit failed").when(success, "edit successful").otherwise(F.concat(F.lit("edit failed with status "), status.cast("string")))
    return F.struct(success.alias("success"), message.alias("message"))


# Phrases of answers to too many requests; the second kind comes with a status of success.
LIMIT_PHRASES = (
    "you've tried to log in too many times", "you're requesting too many pages", "slow down", "too fast", "rate limit", "throttled", "temporarily blocked", "temporarily restricted",
    "captcha", "verify you're human", "prove you're not a robot", "security check", "service temporarily unavailable", "quota exceeded", "limit exceeded", "daily limit",
)
LIMIT_PHRASES_OF_SUCCESS = ("you're requesting a lot of pages",)


def rate_limited(body: Column, status: Column, custom=(), by_status: bool = True, by_phrase: bool = True) -> Column:
    """Whether an answer says that there were too many requests.

    Pages of success hold names of music, so they are searched for the one phrase that can't be a name; other answers for all
    phrases.  ``custom`` phrases count for the latter even without ``by_phrase``.
    """
    low = F.lower(F.coalesce(body, F.lit("")))
    phrases = lambda found: functools.reduce(Column.__or__, [low.contains(p.lower()) for p in found], F.lit(False))
    said = F.when(status.between(200, 299), phrases(LIMIT_PHRASES_OF_SUCCESS if by_phrase else ())).otherwise(phrases((*custom, *(LIMIT_PHRASES if by_phrase else ()))))
    return F.coalesce((status == 429) | said, F.lit(False)) if by_status else F.coalesce(said, F.lit(False))


class _Rows(HTMLParser):
    """Rows of chart tables: names, artists, times, counts, and the fields of their edit forms."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.depth, self.table, self.cell, self.link, self.form = 0, 0, None, False, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "table" and "chartlist" in classes:
            self.table += 1
        elif tag == "tr" and self.table:
            self.row = {"name": "", "artist": "", "timestamp": a.get("data-timestamp"), "playcount": "", "album": None, "album_artist": None}
        if self.row is None:
            return
        for c in ("chartlist-name", "chartlist-artist", "chartlist-count-bar-value"):
            if c in classes:
                self.cell = c.split("-")[1]
        if tag == "a":
            self.link = True
        elif tag == "form" and "data-edit-scrobble" in a:
            self.form = True
        elif tag == "input" and a.get("value"):
            kind = a.get("name")
            if kind == "timestamp" and not self.row["timestamp"]:
                self.row["timestamp"] = a["value"]
            elif self.form and kind in ("album_name", "album_artist_name"):
                self.row["album" if kind == "album_name" else "album_artist"] = a["value"]

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag == "td":
            self.cell = None
        elif tag == "form":
            self.form = False
        elif tag == "table":
            self.table = max(0, self.table - 1)
        elif tag == "tr" and self.row is not None:
            if self.row["name"].strip():
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.row is not None and self.cell == "count":
            self.row["playcount"] += data
        elif self.row is not None and self.link and self.cell in ("name", "artist"):
            self.row[self.cell] += data


_CHART = "page long, place int, name string, artist string, timestamp long, playcount string, album string, album_artist string"


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, html in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
            parser = _Rows()
            parser.feed(html or "")
            for place, r in enumerate(parser.rows):
                when = r["timestamp"]
                rows.append({"page": page, "place": place, "name": r["name"].strip(), "artist": r["artist"].strip(), "timestamp": int(when) if when and when.isdigit() else None, "playcount": r["playcount"].strip() or None, "album": r["album"], "album_artist": r["album_artist"]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page", pa.int64()), ("place", pa.int32()), ("name", pa.string()), ("artist", pa.string()), ("timestamp", pa.int64()), ("playcount", pa.string()), ("album", pa.string()), ("album_artist", pa.string())]))


def chart_rows(pages: DataFrame) -> DataFrame:
    """Rows of the chart tables of HTML pages (page, html); those with an artist are plays or tracks, others albums or artists."""
    return pages.select("page", "html").mapInArrow(_charts, _CHART).withColumn("playcount", number(F.col("playcount")))


def recent_plays(pages: DataFrame) -> DataFrame:
    return chart_rows(pages).filter("artist <> ''")


def page_tracks(pages: DataFrame, artist: Column) -> DataFrame:
    """Of each page the first row of each name; a missing artist is the page's."""
    from pyspark.sql import Window

    order = Window.partitionBy("page", "name").orderBy("place")
    rows = chart_rows(pages).withColumn("artist", F.when(F.col("artist") == "", artist).otherwise(F.col("artist")))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
