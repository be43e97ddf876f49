"""Stored pages as a scan: only pages that may hold a range are opened."""

import json

import pytest

from playlake.sources import page_scan
from playlake.sources.page_scan import newer_than, scraped_window, store_pages, stored_pages, window


def body(number, *rows):
    track = [{"name": n, "artist": {"#text": "A"}, "album": {"#text": ""}, "date": {"uts": str(u)}} for u, n in rows]
    return json.dumps({"recenttracks": {"track": track, "@attr": {"page": str(number), "totalPages": "4"}}})


PAGES = [(1, 900, 1000, [(1000, "a"), (950, "b"), (900, "c")]), (2, 700, 800, [(800, "d"), (700, "e")]), (3, 500, 600, [(600, "f"), (500, "g")]), (4, None, None, [])]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows = [(n, lo, hi, body(n, *tracks)) for n, lo, hi, tracks in PAGES]
    store_pages(spark.createDataFrame(rows, "page_number int, oldest long, newest long, body string").repartition(3), path)
    return path


def opened_pages(df):
    """How many pages a scan has partitions for."""
    return df.rdd.getNumPartitions()


def names(df):
    return sorted(r.name for r in df.collect())


def test_filters_reach_the_files(spark, stored):
    pages = stored_pages(spark, stored)
    assert opened_pages(pages) == 4 == pages.count()
    assert [(r.page_number, r.oldest, r.newest) for r in pages.orderBy("page_number").collect()] == [p[:3] for p in PAGES]
    assert opened_pages(pages.filter("newest >= 699 and oldest < 801")) == 1
    assert opened_pages(pages.filter("page_number > 2")) == 2 and opened_pages(pages.filter("page_number = 3")) == 1
    assert pages.filter("newest > 5000").count() == 0
    assert sorted(r.page_number for r in pages.filter("page_number >= 2 and body like '%d%'").collect()) == [2, 3]
    assert opened_pages(stored_pages(spark, f"file://{stored}").filter("oldest <= 700")) == 2


def test_windows(spark, stored):
    # From 701 on, widened by a second to 700: the second page is read whole, and its older row shows that nothing is missing.
    df = window(spark, stored, 701, 960)
    assert names(df) == ["b", "c", "d", "e"] and opened_pages(df) == 2
    assert names(window(spark, stored, 802, 900)) == [] and opened_pages(window(spark, stored, 802, 900)) == 1
    assert opened_pages(window(spark, stored, 801, 901)) == 2  # a second that lies on the edge
    assert len(names(window(spark, stored, None, None))) == 7


def test_feeds(spark, stored):
    df = newer_than(spark, stored, 700)
    assert names(df) == ["a", "b", "c", "d"] and opened_pages(df) == 2
    assert names(newer_than(spark, stored, 0, first_page=3)) == ["f", "g"]
    assert names(newer_than(spark, stored, 5000)) == []


def test_scraped_pages(spark, tmp_path):
    row = lambda n, u: f'<tr data-timestamp="{u}"><td class="chartlist-name"><a>{n}</a></td><td class="chartlist-artist"><a>A</a></td></tr>'
    html = lambda *rows: f'<table class="chartlist"><tbody>{"".join(rows)}</tbody></table>'
    rows = [(1, 900, 1000, html(row("a", 1000), row("b", 900))), (2, 100, 200, html(row("c", 200), row("d", 100)))]
    path = str(tmp_path / "h")
    store_pages(spark.createDataFrame(rows, "page_number int, oldest long, newest long, body string"), path, "html")
    assert names(scraped_window(spark, path, 950)) == ["b", "c", "d"]
    assert names(scraped_window(spark, path, 500)) == ["c", "d"] and len(page_scan.PageReader(path).partitions()) == 2


def test_no_pages(spark, tmp_path):
    assert stored_pages(spark, str(tmp_path / "none")).count() == 0
