"""Library and search pages."""

from pyspark.sql import functions as F

from playlake.sources import listings


def row(name, artist=None, count=None, more="", attrs=""):
    cells = f'<td class="chartlist-name"><a href="/music/x">{name}</a></td>' if name is not None else "<td>head</td>"
    cells += f'<td class="chartlist-artist"><a>{artist}</a></td>' if artist is not None else ""
    cells += f'<td class="chartlist-count-bar"><span class="chartlist-count-bar-value">{count} plays</span></td>' if count is not None else ""
    return f"<tr {attrs}>{cells}{more}</tr>"


def table(*rows, classes="chartlist"):
    return f'<table class="{classes}"><tbody>{"".join(rows)}</tbody></table>'


def pages_of(spark, htmls, **columns):
    rows = [(k, h, *columns.values()) for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page long, html string" + "".join(f", {c} string" for c in columns))


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tracks_by_element_and_by_row(spark):
    html = '<div data-track-name="Alpha" data-artist-name="Given"></div><div data-track-name="Lost"></div><div data-track-name="Alpha"></div><div data-track-name=""></div>'
    html += table(row("Alpha", "Row", 7), row("Lost", "Row", "x"), row("Beta", "Row", 3), row("Beta", "Other", 9), row("Gamma"), row(None), row("Delta &amp; co", "", "1,234"))
    got = collected(listings.track_listing(pages_of(spark, [html, None, ""], artist="Page", album="Al")), "page", "place", "name", "artist", "album", "playcount")
    assert got == [(0, 0, "Alpha", "Given", "Al", 7), (0, 1, "Beta", "Row", "Al", 3), (0, 2, "Gamma", "Page", "Al", 1), (0, 3, "Delta & co", "Page", "Al", 1)]


def test_counts_by_name_take_the_first_that_can_be_read(spark):
    found = listings.parts(pages_of(spark, [table(row("A", count="1,000"), row("A", count="12"), row("A", count="13"), row("B")) + '<a href="/music/C">C</a>']))
    assert collected(listings.playcounts(found), "name", "playcount") == [("A", 12)]


def test_albums_and_artists(spark):
    named = '<i data-album-name="One"></i><i data-album-name="Two"></i><i data-album-name="One"></i>' + table(row("Two", count=5), row("One", count=4), row("Three", count=3))
    got = collected(listings.album_listing(pages_of(spark, [named, table(row("Row", "ignored", 8)), "<p>"], artist="P")), "page", "place", "name", "artist", "playcount")
    assert got == [(0, 0, "One", "P", 4), (0, 1, "Two", "P", 5), (1, 0, "Row", "P", 8)]
    block = 'class="js-link-block"'
    got = collected(listings.artist_listing(pages_of(spark, [table(row("A", count="3,395", attrs=block), row("B", attrs=block), row("C", count=1))])), "place", "name", "playcount")
    assert got == [(0, "A", 3395), (1, "B", 0)]


def test_search_results(spark):
    more = '<td><form><input name="album" value=" Al "><input name="album_artist" value=" "></form></td>'
    pages = pages_of(spark, [table(row("T", "A", 2, more), row("No artist"))])
    assert collected(listings.search_results(pages, "tracks"), "place", "name", "artist", "album", "album_artist", "playcount") == [(0, "T", "A", "Al", None, 2)]
    assert collected(listings.search_results(pages, "albums"), "name", "album") == [("T", None)]
    assert collected(listings.search_results(pages, "artists").select("name", F.col("artist").isNull().alias("none")), "name", "none") == [("No artist", True), ("T", True)]


def test_paging_of_results(spark):
    rows = spark.createDataFrame([(k // 30 + 1, k % 30, k) for k in range(100)], "page_number int, place int, k int")
    assert [r.k for r in listings.listing_page(rows, 65, 3).collect()] == [65, 66, 67]
    assert [r.k for r in listings.listing_page(rows, 95).collect()] == [95, 96, 97, 98, 99]
    assert listings.listing_page(rows).count() == 100


def test_tracks_of_albums_read_first_pages(spark):
    albums = spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "artist string, album string, album_place int")
    tracks = spark.createDataFrame([("a", "x", 1, 0, "s", 3), ("a", "x", 2, 0, "t", 1), ("a", "y", 1, 0, "s", 2), ("a", "z", 1, 0, "u", 2)], "artist string, album string, page_number int, place int, name string, playcount long")
    assert collected(listings.tracks_of_albums(albums, tracks), "album", "name", "playcount") == [("x", "s", 3), ("y", "s", 2)]


def form(track, artist, album=None, album_artist=None, at="5", aggregate=False):
    fields = {"track_name": track, "artist_name": artist, "album_name": album, "album_artist_name": album_artist, "timestamp": at}
    inputs = "".join(f'<input name="{k}" value="{v}">' for k, v in fields.items() if v is not None)
    return f'<tr><td><form data-edit-scrobble>{inputs}</form>{"<a class=chartlist-count-bar-link></a>" if aggregate else ""}</td></tr>'


def variations(spark, *htmls, track="T", artist="A"):
    rows = [(k, track, artist, k + 1, h) for k, h in enumerate(htmls)]
    df = listings.edit_variations(spark.createDataFrame(rows, "page long, track string, artist string, page_number int, html string"))
    return [(r.album, r.album_artist, r.timestamp) for r in df.orderBy("pos").collect()]


NEXT = '<ul class="pagination"><li class="pagination-next"></li></ul>'


def test_edit_forms(spark):
    exact = table(form("T", "A", "x", "y", "1"), form("T", "A", "x", "y", "2"), form("T", "A", "x", None, "3"), form("B", "A", "other", "o", "4"), form("T", "A", "agg", "g", "5", aggregate=True))
    assert variations(spark, table(form("T", "A", "p", "q"), classes="chartlist chartlist__placeholder") + exact) == [("x", "y", 1), ("x", "A", 3)]
    # No form of this very track: any counts.
    assert variations(spark, table(form("t", "a", "x", "y", "1"))) == [("x", "y", 1)]
    # A form without a time takes its album along; the other forms are then looked at.
    assert variations(spark, table(form("T", "A", "x", "y", "now"), form("t", "a", "x", "y", "2"), form("t", "a", "z", "y", "3"))) == [("z", "y", 3)]
    # Pages go on while there is a next one.
    more = [table(form("T", "A", f"al{k}", "y", str(k))) for k in range(7)]
    assert [v[2] for v in variations(spark, *[m + NEXT for m in more])] == [0, 1, 2, 3, 4]
    assert [v[2] for v in variations(spark, more[0] + NEXT, more[1], more[2])] == [0, 1]
    assert variations(spark, "<p>nothing</p>") == []


def test_names_in_answers(spark):
    htmls = [
        '<table><tr><td class="chartlist-name"><a> Song </a></td><td class="chartlist-album"><a>Al</a></td></tr></table>',
        '<a href="/music/Some+One/_/A%20b%2Bc">x</a> <a href="/music/Some+One/The+Record" class="q">y</a>', "nothing", '<a href="/login?next=/x">',
    ]
    df = pages_of(spark, htmls)
    assert collected(listings.edited_names(df).fillna("-"), "page", "track", "album") == [(0, "Song", "Al"), (1, "A b c", "A b c"), (2, "-", "-"), (3, "-", "-")]
    assert [r[0] for r in df.orderBy("page").select(listings.logged_out(F.col("html"))).collect()] == [False, False, False, True]
