import json

import pytest
from pyspark.sql import functions as F

from playlake.operators import query, store
from playlake.schema import album_artist_of, month_bounds, month_text, play_id, saturated
from playlake.sources.plays import read_log, with_provenance, write_log
from playlake.streaming.merge import View, run_available

JAN, FEB = 1705312800, 1707991200


def log(spark, rows):
    """(uts, artist, track, album, fetched_at, deleted) → observations in order of arrival."""
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "uts long, artist string, track string, album string, fetched_at long, deleted boolean, seq long")
    return df.withColumns({"id": play_id("uts", "artist", "track"), "month": F.date_format(F.timestamp_seconds("uts"), "yyyy-MM"), "source": F.lit("api"), "v": F.lit(1), "album_artist": album_artist_of(F.lit("api"), F.lit(None).cast("string"))})


def test_ids(spark):
    rows = spark.createDataFrame([(1700000000, "Boards of Canada", "Roygbiv"), (1, "ab", "c"), (1, "a", "bc")], "uts long, artist string, track string")
    assert [r[0] for r in rows.select(play_id("uts", "artist", "track")).collect()] == ["1700000000-1bf77af2", "1-6c032e63", "1-40bb547d"]


def test_months():
    assert month_bounds("2024-12") == (1733011200, 1735689600)
    assert month_text(1733011199) == "2024-11"
    assert saturated(2**64 - 1, 0) == 2**63 - 1


def test_counts_and_tombstones(spark):
    rows = [(JAN, "A", "x", None, 1, False), (JAN + 60, "A", "x", None, 1, False), (JAN + 120, "A", "y", None, 1, False), (FEB, "B", "z", None, 1, False), (FEB + 60, "B", "z", None, 1, False), (FEB + 120, "B", "w", None, 1, False)]
    top = query.top_artists(store.live(log(spark, rows)), 10).collect()
    assert [tuple(r) for r in top] == [("A", 3), ("B", 3)]
    assert query.top_tracks(store.live(log(spark, rows)), 1, "B").collect()[0].n == 2
    gone = log(spark, [*rows, (JAN, "A", "x", None, 9, True)])
    assert {r.artist: r.n for r in query.top_artists(store.live(gone), 10).collect()} == {"A": 2, "B": 3}


def test_newer_tombstone_and_title_beat_older_match(spark):
    rows = [(JAN, "A", "x", "Old", 1, False), (JAN, "A", "x", "New", 2, False), (JAN + 1, "A", "y", "Old", 2, False), (JAN + 1, "A", "y", "Old", 2, True)]
    live = store.live(log(spark, rows))
    assert live.filter("album = 'Old'").count() == 0
    assert live.count() == 1
    assert store.point_lookup(log(spark, rows), play_id_of(spark, JAN + 1, "A", "y")).collect()[0].deleted


def play_id_of(spark, uts, artist, track):
    return spark.createDataFrame([(uts, artist, track)], "u long, a string, t string").select(play_id("u", "a", "t")).first()[0]


def test_filters_reach_the_scan(spark, tmp_path):
    log(spark, [(JAN, "A", "x", None, 1, False), (FEB, "B", "y", None, 1, False)]).drop("album_artist").write.partitionBy("month").parquet(str(tmp_path / "p"))
    plan = store.live(spark.read.parquet(str(tmp_path / "p")), JAN, JAN + 10)._jdf.queryExecution().executedPlan().toString()
    assert "2024-01" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_albums(spark):
    rows = [(JAN, "A", "x", "One", 1, False), (JAN + 60, "A", "y", "One", 1, False), (JAN + 120, "A", "z", "Two", 1, False), (FEB, "B", "w", "Three", 1, False), (FEB + 60, "A", "n", None, 1, False), (FEB + 120, "A", "e", "", 1, False)]
    live = store.live(log(spark, rows))
    assert [tuple(r) for r in query.top_albums(live, 10).collect()] == [("A", "One", 2), ("A", "Two", 1), ("B", "Three", 1)]
    assert query.play_count(store.live(log(spark, rows), JAN, JAN + 121)).first().n == 3


def test_keyset_walk(spark):
    rows = [(JAN, "A", "x", None, 1, False), (JAN, "A", "y", None, 1, False), (JAN + 60, "A", "z", None, 1, False), (FEB, "B", "w", None, 1, False), (FEB + 60, "B", "v", None, 1, False)]
    live, cursor, seen = store.live(log(spark, rows)), None, []
    while page := query.recent(live, 2, cursor).collect():
        seen += [(r.uts, r.id) for r in page]
        cursor = seen[-1]
    assert len(set(seen)) == 5 and seen == sorted(seen, reverse=True)


def test_search(spark):
    rows = [(JAN, "The Lamp Posts", "Evening Tram", "Late Lines", 1, False), (JAN + 60, "The Lamp Posts", "Evening Tram", "Late Lines", 1, False), (FEB, "The Lamp Posts", "Ferry", "Harbour", 1, False), (FEB + 60, "Nobody", "Evening Tram", None, 1, False)]
    live = store.live(log(spark, rows))
    found = query.search_groups(live, "lamp tram", 10).collect()
    assert [(r.n, r.first_uts, r.latest_uts) for r in found] == [(2, JAN, JAN + 60)]
    assert query.search_groups(live, "harb", 10).count() == 1
    assert query.search_groups(live, "%", 10).count() == 0
    assert query.search_groups(live, "", 10).count() == 3
    assert query.search_groups(live, "evening", 1, 1).first().artist == "The Lamp Posts"


def test_append_classes(spark):
    held = log(spark, [(JAN, "A", "x", None, 1, False)])
    batch = log(spark, [(JAN, "A", "x", None, 1, False), (JAN, "A", "x", "Corrected", 2, False), (JAN, "A", "x", "Late", 1, False), (JAN + 1, "A", "y", None, 1, False), (JAN + 1, "A", "y", None, 1, False)])
    assert store.append_stats(held, batch).first().asDict() == {"n_new": 1, "n_updated": 1, "n_unchanged": 3}


def test_log_files_and_torn_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    write_log(log(spark, [(JAN, "A", "x", None, 1, False), (FEB, "B", "y", "Al", 2, False)]), path)
    (tmp_path / "log" / "month=2024-01" / "torn.json").write_text('\n{"id":"170531')
    rows = read_log(spark, path)
    assert sorted((r.uts, r.month, r.album) for r in rows.collect()) == [(JAN, "2024-01", None), (FEB, "2024-02", "Al")]


def test_compaction_keeps_tombstones(spark):
    rows = log(spark, [(JAN, "A", "x", None, 1, False), (JAN, "A", "x", None, 2, True), (JAN + 1, "A", "y", None, 1, False)])
    kept = store.compact(rows).collect()
    assert [(r.uts, r.deleted) for r in kept] == [(JAN, True), (JAN + 1, False)]
    assert store.compact_counts(rows).first().dropped == 1


def test_provenance(spark):
    tracks = spark.createDataFrame([("n", "a", None, "aa", 5), ("m", "a", None, None, 6), ("now", "a", None, None, None)], "name string, artist string, album string, album_artist string, timestamp long")
    got = {r.track: r.album_artist.state for r in with_provenance(tracks, "scrape", 1).collect()}
    assert got == {"n": "verified", "m": "unknown"}
    assert with_provenance(tracks, "api", 1).filter("track = 'n'").first().album_artist.state == "unverified"
    assert json.loads(with_provenance(tracks, "api", 1).filter("track = 'm'").select(F.to_json("album_artist")).first()[0]) == {"state": "unknown"}


def test_stream_merges_once(spark, tmp_path):
    source, view, mark = (str(tmp_path / n) for n in ("log", "view", "mark"))
    write_log(log(spark, [(JAN, "A", "x", None, 1, False), (FEB, "B", "y", None, 1, False)]), source)
    run_available(spark, source, view, mark)
    write_log(log(spark, [(JAN, "A", "x", "New", 2, False), (JAN + 5, "A", "z", None, 1, False)]), source)
    run_available(spark, source, view, mark)
    run_available(spark, source, view, mark)
    assert sorted((r.uts, r.album) for r in View(spark, view).read().collect()) == [(JAN, "New"), (JAN + 5, None), (FEB, None)]
    # A merge that breaks off before its manifest leaves the view as it was; files that nothing reads go with a later one.
    held = View(spark, view)
    version, before = held.version(), held.months()
    lost = log(spark, [(JAN, "A", "x", "Lost", 9, False)])
    held.files.write, write = (lambda *_: (_ for _ in ()).throw(OSError("stopped"))), held.files.write
    with pytest.raises(OSError):
        held.merge(lost)
    held.files.write = write
    assert (held.version(), held.months()) == (version, before) and held.read().filter("album = 'Lost'").count() == 0
    held.merge(log(spark, [(FEB, "B", "y", "Last", 9, False)]))
    held.merge(log(spark, [(FEB, "B", "y", "Very last", 10, False)]))
    assert sorted(str(r.album) for r in held.read().collect()) == ["New", "None", "Very last"]
    assert len(list((tmp_path / "view" / "data").iterdir())) <= 3


def test_empty_log(spark):
    none = log(spark, [(JAN, "A", "x", None, 1, False)]).limit(0)
    assert store.live(none).count() == 0
    assert store.latest_uts(none).first()[0] is None
    assert query.search_groups(none, "x", 5).count() == 0


def test_unknown_fields_come_back_whole(spark, tmp_path):
    """Fields of other versions outlive the fold and the writing; names, texts and numbers as they were, also nested and null ones."""
    first, second = f"{JAN}-1bf77af2", f"{FEB}-40bb547d"
    lines = [
        {"id": first, "uts": JAN, "artist": "A", "track": "x", "fetched_at": 1, "seq": 1, "mood": "old"},
        {"id": first, "uts": JAN, "artist": "A", "track": "x }", "fetched_at": 2, "seq": 2, "mood": 'q"\\ü', "score": 1.5, "n": 12345678901234, "tags": [1, "b", None, {"c": {}}], "none": None, "Track": "other case"},
        {"id": second, "uts": FEB, "artist": "B", "track": "y", "fetched_at": 1, "seq": 3, "deleted": True},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(lines[0]), "", '{"id": "torn', *map(json.dumps, lines[1:])]) + "\n")
    write_log(store.current(read_log(spark, f"{tmp_path}/in", unknown=True)), f"{tmp_path}/out")
    found = {r["id"]: r for r in (json.loads(line) for f in (tmp_path / "out").rglob("*.txt") for line in f.read_text().splitlines())}
    for line in lines[1:]:
        assert {k: v for k, v in found[line["id"]].items() if k in line} == line
    assert set(found) == {first, second} and "mood" not in found[second]
    again = read_log(spark, f"{tmp_path}/out", unknown=True)
    assert again.filter("unknown is null").count() == 1 and again.filter(F.col("track") == "x }").select(F.variant_get(F.col("unknown")["tags"], "$[1]", "string")).first()[0] == "b"
    plain = ["id", "uts", "artist", "track", "fetched_at", "deleted", "month"]
    assert sorted(map(tuple, read_log(spark, f"{tmp_path}/out").select(*plain).collect())) == sorted(map(tuple, again.select(*plain).collect()))
