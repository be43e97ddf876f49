"""Library and search pages: their parts, and what tracks, albums, artists and edit forms they list.

One small parser turns a page into an array of its parts, once a page.  All that is decided about them, such as which element names a track, whose
count it has, or which form counts, is native functions of that array; as it is all within a page, no listing shuffles.  Only the pages of
a track's edit forms meet, five at most and without their HTML.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from playlake.sources.pages import number

_TEXTS = ("name", "artist", "album", "bar", "count", "timestamp", "href")
_FLAGS = ("chart", "body", "block", "placeholder", "aggregate")
_MAP = pa.map_(pa.string(), pa.string())
_PART = pa.struct([("place", pa.int32()), ("kind", pa.string()), ("row", pa.int32()), ("table", pa.int32()), *[(f, pa.bool_()) for f in _FLAGS], *[(t, pa.string()) for t in _TEXTS], ("inputs", _MAP), ("form", _MAP)])
_PART_DDL = "struct<place:int,kind:string,row:int,`table`:int," + ",".join(f"{f}:boolean" for f in _FLAGS) + "," + ",".join(f"{t}:string" for t in _TEXTS) + ",inputs:map<string,string>,form:map<string,string>>"
#: Parts of a batch on its way back.
_BATCH = 8192
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Parts(HTMLParser):
    """Rows of tables, elements that name a track or album in an attribute, and links to music."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[dict] = []
        self.row: dict | None = None
        self.rows, self.tables = 0, 0
        self.table: dict | None = None
        self.body = self.in_form = False
        #: Open elements that something is read from: [tag, depth of the same tag within, what, pieces of text].
        self.open: list[list] = []

    def _part(self, kind: str, **values) -> dict:
        part = {"place": len(self.parts), "kind": kind, "row": self.row["row"] if self.row else None} | values
        self.parts.append(part)
        return part

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        for element in self.open:
            element[1] += element[0] == tag and tag not in _VOID
        if tag == "table":
            self.tables += 1
            self.table = {"table": self.tables, "chart": "chartlist" in classes, "placeholder": "chartlist__placeholder" in classes}
        elif tag == "tbody":
            self.body = True
        elif tag == "tr":
            self.rows += 1
            self.row = None
            self.row = self._part("row", **(self.table or {"table": None, "chart": False, "placeholder": False}), body=self.body, block="js-link-block" in classes, aggregate=False, timestamp=a.get("data-timestamp"), inputs={}, form=None)
            self.row["row"] = self.rows
        for kind in ("track", "album"):
            if f"data-{kind}-name" in a:
                self._part(kind, name=a[f"data-{kind}-name"], artist=a.get("data-artist-name"))
        if tag == "a" and "/music/" in a.get("href", ""):
            self.open.append([tag, 0, self._part("link", href=a["href"]), []])
        if self.row is None or tag in _VOID:
            if self.row is not None and tag == "input" and "name" in a:
                self.row["inputs"].setdefault(a["name"], a.get("value"))
                if self.in_form:
                    self.row["form"].setdefault(a["name"], a.get("value"))
            return
        self.row["aggregate"] |= "chartlist-count-bar-link" in classes
        scopes = {e[2] for e in self.open if isinstance(e[2], str)}
        for field in ("name", "artist", "album"):
            if f"chartlist-{field}" in classes:
                self.open.append([tag, 0, f"scope {field}", []])
            elif tag == "a" and f"scope {field}" in scopes and field not in self.row:
                self.row[field] = ""
                self.open.append([tag, 0, field, []])
        for field, mark in (("bar", "chartlist-count-bar-value"), ("count", "chartlist-count-bar")):
            if mark in classes and field not in self.row:
                self.row[field] = ""
                self.open.append([tag, 0, field, []])
        if tag == "form" and "data-edit-scrobble" in a and self.row["form"] is None:
            self.row["form"], self.in_form = {}, True

    def handle_endtag(self, tag):
        for element in [e for e in self.open if e[0] == tag]:
            if element[1]:
                element[1] -= 1
                continue
            self.open.remove(element)
            if isinstance(element[2], dict):
                element[2]["name"] = "".join(element[3]).strip()
            elif self.row is not None and not element[2].startswith("scope"):
                self.row[element[2]] = "".join(element[3]).strip()
        if tag == "form":
            self.in_form = False
        elif tag == "tr":
            self.row = None
        elif tag == "tbody":
            self.body = False
        elif tag == "table":
            self.table = None

    def handle_data(self, data):
        for element in self.open:
            element[3].append(data)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages whose last column is their HTML → the other columns, and the pages' parts."""
    for batch in batches:
        html, first, found, ends = batch.column(batch.num_columns - 1), 0, [], [0]
        for k in range(batch.num_rows):
            parser = _Parts()
            parser.feed(html[k].as_py() or "")
            parser.close()
            bars = {p["row"]: p.get("bar") for p in parser.parts if p["kind"] == "row"}
            found += (p if p["kind"] == "row" else p | {"bar": bars.get(p["row"])} for p in parser.parts)
            ends.append(len(found))
            if len(found) >= _BATCH or k + 1 == batch.num_rows:
                fields = [pa.array([list(v.items()) if isinstance(v := p.get(f.name), dict) else v for p in found], f.type) for f in _PART]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_PART)))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, k + 1 - first).columns[:-1], lists], [*batch.schema.names[:-1], "parts"])
                first, found, ends = k + 1, [], [0]


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages (page, html) → page, the columns to keep, and ``parts``: each table row, named element and link, in the page's order; no html has none.

    A link's ``bar`` is that of the table row in which it stands.
    """
    found = pages.select("page", *keep, "html")
    schema = T.StructType([*found.schema.fields[:-1], T.StructField("parts", T.ArrayType(T._parse_datatype_string(_PART_DDL)))])
    return found.mapInArrow(_parsed, schema)


def parts(pages: DataFrame) -> DataFrame:
    """Pages (page, html) → a row for each part."""
    return parsed(pages).select("page", F.inline("parts"))


def count_of(text: Column) -> Column:
    """The first word of a text, if it is a whole number as it stands (no commas), below 2^32."""
    word = F.element_at(F.split(F.trim(text), r"\s+"), 1)
    value = F.when(word.rlike(r"^\+?[0-9]{1,10}$"), word.try_cast("long"))
    return F.when(value < 1 << 32, value)


def playcounts(found: DataFrame) -> DataFrame:
    """(page, name, playcount) by name: of the links with that text, the first whose row has a count that can be read."""
    counted = found.filter("kind = 'link'").select("page", "name", "place", count_of(F.col("bar")).alias("playcount")).filter("playcount is not null")
    return counted.groupBy("page", "name").agg(F.min_by("playcount", "place").alias("playcount"))


def _of(kind: str, also=lambda p: F.lit(True)) -> Column:
    return F.filter("parts", lambda p: (p["kind"] == kind) & also(p))


def _chart(p: Column) -> Column:
    return p["chart"] & p["body"] & p["name"].isNotNull()


def _names(items: str) -> Column:
    return F.transform(items, lambda x: x["name"])


def _each_name(items: str) -> Column:
    """The first item of each name."""
    return F.filter(items, lambda x, i: F.array_position(_names(items), x["name"]) == i + 1)


def _counted_row(p: Column) -> Column:
    return F.coalesce(count_of(p["bar"]), F.lit(1))


def _with_counted(pages: DataFrame, kind: str) -> DataFrame:
    """Adds ``named``, the elements that name a ``kind``, each name once; ``counted``, those for which the page has a count; and ``counts``, the links that have one."""
    found = pages.withColumn("counts", _of("link", lambda p: count_of(p["bar"]).isNotNull())).withColumn("count_names", _names("counts"))
    found = found.withColumn("named", _of(kind, lambda p: p["name"] != "")).withColumn("named", _each_name("named"))
    count = lambda x: count_of(F.element_at("counts", F.array_position("count_names", x["name"]).cast("int"))["bar"])
    kept = F.filter("named", lambda x: F.array_contains("count_names", x["name"]))
    return found.withColumn("counted", F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["artist"].alias("artist"), count(x).alias("playcount"))))


def track_listing(pages: DataFrame) -> DataFrame:
    """Track pages (page, html, artist, album?) → page, place, name, artist, album, playcount: each name once.

    Elements that name a track come first, with the count that the page has for the name; those without one are left out and
    their names' table rows too.  Then the other table rows.  A missing artist is the page's.
    """
    given = pages.select("page", "html", F.col("artist").alias("p_artist"), (F.col("album") if "album" in pages.columns else F.lit(None).cast("string")).alias("p_album"))
    found = _with_counted(parsed(given, "p_artist", "p_album"), "track").withColumn("taken", _names("named"))
    found = found.withColumn("rest", _of("row", lambda p: _chart(p) & ~F.array_contains("taken", p["name"]))).withColumn("rest", _each_name("rest"))
    rest = F.transform("rest", lambda x: F.struct(x["name"].alias("name"), F.when(F.coalesce(x["artist"], F.lit("")) != "", x["artist"]).alias("artist"), _counted_row(x).alias("playcount")))
    rows = found.select("page", "p_artist", "p_album", F.posexplode(F.concat("counted", rest)).alias("place", "t"))
    return rows.select("page", "place", F.col("t.name").alias("name"), F.coalesce("t.artist", "p_artist").alias("artist"), F.col("p_album").alias("album"), F.col("t.playcount").alias("playcount"))


def album_listing(pages: DataFrame) -> DataFrame:
    """Album pages (page, html, artist) → page, place, name, artist, playcount: the elements that name an album, or, on pages without any, the table rows."""
    found = _with_counted(parsed(pages.select("page", "html", F.col("artist").alias("p_artist")), "p_artist"), "album").withColumn("any", F.exists("parts", lambda p: p["kind"] == "album"))
    rows = F.transform(_of("row", _chart), lambda x: F.struct(x["name"].alias("name"), x["artist"].alias("artist"), _counted_row(x).alias("playcount")))
    listed = found.select("page", "p_artist", F.posexplode(F.when(F.col("any"), F.col("counted")).otherwise(rows)).alias("place", "t"))
    return listed.select("page", "place", F.col("t.name").alias("name"), F.col("p_artist").alias("artist"), F.col("t.playcount").alias("playcount"))


def artist_listing(pages: DataFrame) -> DataFrame:
    """Artist pages → page, place, name, playcount: link rows of chart tables; counts may have commas, 0 if there is none."""
    rows = parsed(pages).select("page", F.posexplode(_of("row", lambda p: p["chart"] & p["block"] & p["name"].isNotNull())).alias("place", "t"))
    count = F.when(F.col("t.count").rlike(r"^\s*[0-9][0-9,]*(\s|$)"), number(F.col("t.count"))).otherwise(F.lit(0))
    return rows.select("page", "place", F.col("t.name").alias("name"), count.alias("playcount"))


def search_results(pages: DataFrame, kind: str) -> DataFrame:
    """Result pages for ``kind`` tracks, albums or artists → page, place, name, artist, album, album_artist, playcount.

    Tracks and albums without an artist are left out; albums of tracks stand in the row's inputs.
    """
    wanted = _chart if kind == "artists" else (lambda p: _chart(p) & p["artist"].isNotNull())
    rows = parsed(pages).select("page", F.posexplode(_of("row", wanted)).alias("place", "t"))
    given = lambda n: F.nullif(F.trim(F.try_element_at("t.inputs", F.lit(n))), F.lit("")) if kind == "tracks" else F.lit(None).cast("string")
    artist = F.col("t.artist") if kind != "artists" else F.lit(None).cast("string")
    return rows.select("page", "place", F.col("t.name").alias("name"), artist.alias("artist"), given("album").alias("album"), given("album_artist").alias("album_artist"), _counted_row(F.col("t")).alias("playcount"))


def listing_page(rows: DataFrame, offset: int = 0, limit: int = 0, per_page: int = 30) -> DataFrame:
    """Rows (page_number from 1, place) from ``offset`` on, at most ``limit`` (0: all); pages before the offset's aren't read."""
    ordered = rows.filter(F.col("page_number") >= offset // per_page + 1).orderBy("page_number", "place").offset(offset % per_page)
    return ordered.limit(limit) if limit else ordered


def tracks_of_albums(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """An artist's tracks by way of their albums: each album (artist, album, album_place) with the tracks (artist, album, page_number, place, name, playcount) of its first page."""
    held = tracks.filter("page_number = 1").drop("page_number")
    return albums.join(held, ["artist", "album"])


# --- edit forms -------------------------------------------------------------------------------------------------------

MOST_FORM_PAGES = 5
_FORM = "struct<form_track:string,form_artist:string,album:string,album_artist:string,timestamp:bigint,exact:boolean>"
_PAIR = "array<struct<album:string,album_artist:string>>"


def _forms() -> Column:
    """The edit forms of a page: those of the first chart table that isn't a placeholder, without rows of aggregates."""
    usable = lambda p: p["chart"] & ~p["placeholder"]
    first = F.array_min(F.transform(_of("row", usable), lambda p: p["table"]))
    rows = _of("row", lambda p: usable(p) & (p["table"] == first) & ~p["aggregate"] & p["form"].isNotNull())

    def form(p: Column) -> Column:
        text = lambda n: F.coalesce(F.try_element_at(p["form"], F.lit(n)), F.lit(""))
        given, stamp = F.try_element_at(p["form"], F.lit("album_artist_name")), F.try_element_at(p["form"], F.lit("timestamp"))
        exact = (text("track_name") == F.col("track")) & (text("artist_name") == F.col("artist"))
        return F.struct(
            text("track_name").alias("form_track"), text("artist_name").alias("form_artist"), text("album_name").alias("album"), F.coalesce(given, text("artist_name")).alias("album_artist"),
            F.when(stamp.rlike(r"^\+?[0-9]{1,18}$"), stamp.try_cast("long")).alias("timestamp"), F.coalesce(exact, F.lit(False)).alias("exact"),
        )

    return F.transform(rows, form)


def _pairs(forms: Column) -> Column:
    return F.transform(forms, lambda x: F.struct(x["album"].alias("album"), x["album_artist"].alias("album_artist")))


def _new(forms: Column, seen: Column) -> Column:
    """Forms whose pair of album and album artist is seen for the first time, and that have a time."""
    pairs = _pairs(forms)
    pair = lambda x: F.struct(x["album"].alias("album"), x["album_artist"].alias("album_artist"))
    return F.filter(forms, lambda x, i: (F.array_position(pairs, pair(x)) == i + 1) & ~F.array_contains(seen, pair(x)) & x["timestamp"].isNotNull())


def _read_page(state: Column, page: Column) -> Column:
    """What is known after one more page: forms of exactly this track and artist, or, if these bring nothing new, any."""
    exact = F.filter(page["forms"], lambda x: x["exact"])
    found, seen = _new(exact, state["seen"]), F.array_union(state["seen"], _pairs(exact))
    none = F.size(found) == 0
    after = F.struct(
        page["more"].alias("going"), F.when(none, F.array_union(seen, _pairs(page["forms"]))).otherwise(seen).alias("seen"),
        F.concat(state["found"], F.when(none, _new(page["forms"], seen)).otherwise(found)).alias("found"),
    )
    stop = F.struct(F.lit(False).alias("going"), state["seen"].alias("seen"), state["found"].alias("found"))
    return F.when(state["going"] & page.isNotNull(), after).otherwise(stop)


def edit_variations(pages: DataFrame) -> DataFrame:
    """Track pages (page, track, artist, page_number, html) → the album variations that their edit forms offer, in order.

    Forms stand in the first chart table that isn't a placeholder; rows of aggregates have none.  On each page the forms of
    exactly this track and artist count, or, if those bring nothing new, any form.  A pair of album and album artist counts once,
    even if its form has no time and is left out.  Without a field for it the album artist is the artist.  Pages are read up to the
    fifth, as long as each has a next one; of pages that share a number the one with the smallest ``page`` counts.
    """
    more = F.coalesce(F.col("html").rlike(r"""class="[^"]*\bpagination-next\b"""), F.lit(False))
    held = parsed(pages.filter(F.col("page_number").between(1, MOST_FORM_PAGES)).withColumn("more", more), "track", "artist", "page_number", "more")
    held = held.select("page", "track", "artist", "page_number", "more", _forms().alias("forms"))
    numbered = [F.min(F.when(F.col("page_number") == n, F.struct("page", "more", "forms"))).alias(f"p{n}") for n in range(1, MOST_FORM_PAGES + 1)]
    tracks = held.groupBy("track", "artist").agg(*numbered)
    start = F.struct(F.lit(True).alias("going"), F.array().cast(_PAIR).alias("seen"), F.array().cast(f"array<{_FORM}>").alias("found"))
    found = F.aggregate(F.array(*[f"p{n}" for n in range(1, MOST_FORM_PAGES + 1)]), start, _read_page, lambda s: s["found"])
    return tracks.select("track", "artist", F.posexplode(found).alias("pos", "f")).select("track", "artist", F.col("pos").cast("long").alias("pos"), *(F.col(f"f.{c}").alias(c) for c in ("form_track", "form_artist", "album", "album_artist", "timestamp")))


def edited_names(pages: DataFrame) -> DataFrame:
    """Answers to edits (page, html) → page, track, album: the first names in their chart rows, else what their links to music spell.

    An address names the artist, then an album, or ``_`` and a track.  Fixed behaviour: an album is read from the last step of the first address that goes beyond
    the artist, even to a track, and has no underscore in it.
    """
    found = parsed(pages).withColumn("rows", _of("row"))
    steps = lambda p: F.slice(F.split(F.element_at(F.split(F.split_part(p["href"], F.lit("?"), F.lit(1)), "/music/", 2), 2), "/"), 2, 1000)
    found = found.withColumn("beyond", F.filter(F.transform(_of("link"), steps), lambda s: F.size(s) > 0))
    named = lambda c: F.try_element_at(F.filter("rows", lambda p: p[c].isNotNull()), F.lit(1))[c]

    def spelled(of) -> Column:
        raw = F.nullif(F.element_at(F.try_element_at(F.filter("beyond", of), F.lit(1)), -1), F.lit(""))
        return F.replace(F.coalesce(F.try_url_decode(raw), raw), F.lit("+"), F.lit(" "))

    track = spelled(lambda s: (F.size(s) > 1) & (F.element_at(s, 1) == "_") & (F.element_at(s, -1) != ""))
    album = spelled(lambda s: (F.element_at(s, -1) != "") & ~F.contains(F.element_at(s, -1), F.lit("_")))
    return found.select("page", F.coalesce(named("name"), track).alias("track"), F.coalesce(named("album"), album).alias("album"))


def logged_out(html: Column) -> Column:
    """Whether a page was made for a visitor who isn't logged in."""
    return F.coalesce(html.contains("/login?next="), F.lit(False))
