import random

from pyspark.sql import functions as F

from playlake.operators import reconcile, releases, subjects
from playlake.sources import pages


def test_api_pages(spark):
    track = '{"name":"n","artist":{"#text":"a"},"album":{"#text":""},"date":{"uts":"%s"}}'
    now = '{"name":"n","artist":{"#text":"a"},"album":{"#text":"b"},"@attr":{"nowplaying":"true"}}'
    attr = '"@attr":{"page":"%d","totalPages":"3"}'
    bodies = ['{"recenttracks":{"track":[' + now + "," + track % 10 + "," + track % 20 + "]," + attr % 1 + "}}", '{"recenttracks":{"track":' + track % 30 + "," + attr % 2 + "}}", '{"recenttracks":{' + attr % 3 + "}}", '{"error":6,"message":"User not found"}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [(r.page_number, r.has_next, r.error) for r in pages.api_pages(df).collect()] == [(1, True, None), (2, True, None), (3, False, None), (1, False, "error 6: User not found")]
    assert sorted((r.page_number, r.timestamp, r.album) for r in pages.api_tracks(df).collect()) == [(1, 10, None), (1, 20, None), (2, 30, None)]
    assert pages.api_tracks(df, before=20).count() == 1


def test_html(spark):
    html = """<table class="chartlist"><tbody><tr data-timestamp="5"><td class="chartlist-name"><a>One &amp; two</a></td><td class="chartlist-artist"><a>A</a></td>
      <td><form data-edit-scrobble><input name="album_name" value="Al"><input name="album_artist_name" value=""></form></td></tr>
      <tr><td class="chartlist-name"><a>Three</a></td><td><input name="timestamp" value="7"><span class="chartlist-count-bar-value">1,234 scrobbles</span></td></tr><tr><td>nothing</td></tr></table>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page long, html string")
    got = [(r.name, r.artist, r.timestamp, r.album, r.album_artist, r.playcount) for r in pages.chart_rows(df).orderBy("place").collect()]
    assert got == [("One & two", "A", 5, "Al", None, 1), ("Three", "", 7, None, None, 1234)]
    assert [r.artist for r in pages.page_tracks(df, F.lit("P")).orderBy("place").collect()] == ["A", "P"]


def test_paginators(spark):
    rows = [("Page 1 of 42", 42, False), (None, 1, False), ('<a href="?page=3">3</a><a href="?page=7" aria-label="Next">Next</a>', 7, True)]
    df = spark.createDataFrame([(p,) for p, _, _ in rows], "p string").select(pages.total_pages(F.col("p")).alias("t"), pages.has_next(F.col("p")).alias("n"))
    assert [(r.t, r.n) for r in df.collect()] == [(t, n) for _, t, n in rows]


def test_forms_and_numbers(spark):
    row = spark.createDataFrame([("a=1&b=x+y%21&a=2&c", " 1,234 plays", "https://h.example/p/q?x=1&y=a%20b#z")], "f string, n string, u string")
    r = row.select(pages.form_fields(F.col("f")).alias("f"), pages.number(F.col("n")).alias("n"), pages.request_parts(F.col("u")).alias("u"), pages.form_fields(F.lit("")).alias("e")).first()
    assert r.f == {"a": "2", "b": "x y!", "c": ""} and r.n == 1234 and r.u.path == "/p/q" and r.u.query == {"x": "1", "y": "a b"} and r.e == {}


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "ABC"), ("ab", "abcd"), ("", "x")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(releases.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.25, -0.5]


def test_gap_rule_in_order_of_arrival(spark):
    """Random releases against insertion one by one; the rule runs in circles in some of them."""
    rng, rows = random.Random(2), []
    for key in range(60):
        for pos in range(rng.randrange(1, 12)):
            rows.append((key, f"{key}-{rng.randrange(40)}", rng.choice(["a", "a (Deluxe)"]), rng.choice(["Official", None, "Bootleg"]), rng.choice(["Album", "Single", "EP", None]), rng.choice([None, "19", "1960", "1971-02", "1972", "1983-01-01", "1995"]), rng.choice([["Various"], ["x"], None]), pos))

    # The single precedes the album by the rule, the album the EP by type, the EP the single.
    rows += [(60, f"60-{k}", "a", "Official", kind, year, ["x"], k) for k, (kind, year) in enumerate([("Single", "1970"), ("EP", "1980"), ("Album", "1985"), ("Single", "1984")])]

    def precedes(a, b):
        for x, y in zip(a[:3], b[:3]):
            if x != y:
                return x < y
        (ka, ya), (kb, yb) = a[6:], b[6:]
        if None not in (ya, yb) and (ka, kb) == ("Single", "Album") and ya + 10 <= yb:
            return True
        if None not in (ya, yb) and (ka, kb) == ("Album", "Single") and yb + 10 <= ya:
            return False
        return a[3:6] < b[3:6]

    want, circles = [], 0
    for key in range(61):
        seen, own = set(), []
        for _, i, title, status, kind, date, credit, pos in (r for r in rows if r[0] == key):
            if i not in seen:
                seen.add(i)
                year = int(date[:4]) if date and len(date) >= 4 else None
                own.append(((({"Official": 0, None: 1, "Bootleg": 3}[status]), credit == ["Various"], "Deluxe" in title, {"Album": 0, "EP": 1, "Single": 2, None: 4}[kind], 1_000_000_000 if year is None else year, pos, kind, year), i))
        held = []
        for x in sorted(own, key=lambda r: (r[0][0], r[0][5])):
            at = len(held)
            while at and precedes(x[0], held[at - 1][0]):
                at -= 1
            held.insert(at, x)
        circles += any(precedes(b[0], a[0]) for n, a in enumerate(held) for b in held[n + 1 :])
        want += [(key, i, n + 1) for n, (_, i) in enumerate(held)]
    df = spark.createDataFrame(rows, "key long, id string, title string, status string, primary_type string, date string, artist_credit array<string>, pos long").withColumn("secondary_types", F.lit(None).cast("array<string>"))
    got = releases.ranked_with_gap(df, ["key"])
    assert sorted((r["key"], r["id"], r["rank"]) for r in got.collect()) == sorted(want) and circles > 0


def test_gap_rule(spark):
    rows = [("k", "album", "Album", "2000", 0), ("k", "single", "Single", "1985", 1), ("k", "late", "Single", "1995", 2)]
    df = spark.createDataFrame([(k, i, "t", None, t, d, p) for k, i, t, d, p in rows], "key string, id string, title string, status string, primary_type string, date string, pos long").withColumns({"artist_credit": F.array(F.lit("x")), "secondary_types": F.array().cast("array<string>")})
    assert [r.id for r in releases.ranked(df, ["key"]).orderBy("rank").collect()] == ["album", "single", "late"]
    assert [r.id for r in releases.ranked_with_gap(df, ["key"]).orderBy("rank").collect()][0] == "single"


def test_subject_joins_are_null_safe(spark):
    schema = "artist string, track string, album string, album_artist string"
    a = spark.createDataFrame([("a", "t", None, None), ("a", "t", "x", None)], schema)
    assert [r.album for r in subjects.without(a, spark.createDataFrame([("a", "t", None, None)], schema)).collect()] == ["x"]


def test_enable_defaults(spark):
    mine, more = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert sorted(str(r.name) for r in reconcile.enable_defaults(mine, more).collect()) == ["None", "a", "b"]
