"""State files, texts, guards, reports, subjects and the catalogue."""

import pytest
from pyspark.sql import functions as F

from playlake.functions import texts
from playlake.operators import eventlog, query, reconcile, releases, subjects
from playlake.plans import planner
from playlake.sources import pages, state


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files(spark, tmp_path):
    path = str(tmp_path / "s")
    assert state.load_rules(spark, path) == [] and state.load_state(spark, path) == {} and state.load_coverage(spark, path).count() == 0
    state.save_rules(spark, path, [{"name": "a"}])
    state.save_rules(spark, path, [{"name": "b"}])
    assert state.load_rules(spark, path) == [{"name": "b"}]
    state.save_state(spark, path, last_sync_at=5)
    state.save_state(spark, path, history_start=1)
    assert state.load_state(spark, path) == {"last_sync_at": 5, "history_start": 1}
    schema = "start long, `end` long, verified_at long"
    state.save_coverage(spark, path, spark.createDataFrame([(5, 9, 1), (1, 5, 2)], schema), "my/provider")
    assert rows_of(state.load_coverage(spark, path, "my/provider").select("start", "end", "verified_at")) == [(1, 9, 1)]
    # Lines of two machines that were merged into one file heal when it is read.
    state.StateFiles(spark, path).write("coverage.json", '[{"start":1,"end":4,"verified_at":3},{"start":2,"end":6,"verified_at":2},{"start":9,"end":9,"verified_at":2}]')
    assert rows_of(state.load_coverage(spark, path).select("start", "end", "verified_at")) == [(1, 6, 2)]
    assert state.StateFiles(spark, path).names() == ["coverage-my_provider.json", "coverage.json", "rules.json", "state.json"] or all(not n.startswith(".") or n.endswith(".crc") for n in state.StateFiles(spark, path).names())


def test_event_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    state.append_events(spark.createDataFrame([("a", 1, "queued")], "id string, seq long, event string"), path)
    state.append_events(spark.createDataFrame([("a", 2, "applied")], "id string, seq long, event string"), path)
    (tmp_path / "log" / "torn.json").write_text('{"id":"b","seq":3,"event":"queued"}\n{"id":"c","se\n\n')
    assert rows_of(state.read_events(spark, path, "id string, seq long, event string")) == [("a", 1, "queued"), ("a", 2, "applied"), ("b", 3, "queued")]
    assert rows_of(state.lines(spark.createDataFrame([(1, None)], "n long, x string"), "found")) == [('{"event":"found","n":1}',)]


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "m")
    targets = spark.createDataFrame([(1, None, "A", "t", None, 5), (2, 3, "B", "u", "x", 6)], "index long, offset long, artist string, track string, album string, timestamp long")
    state.write_manifest(targets, path, "range", 99)
    assert rows_of(state.read_manifest(spark, path)) == rows_of(targets)
    state.StateFiles(spark, path).write("head.json", '{"version": 2}')
    with pytest.raises(ValueError, match="version 2"):
        state.read_manifest(spark, path)


def test_numbers_of_a_manifest_run_through(spark):
    plays = spark.createDataFrame([(str(k), k * 40_000) for k in range(9)], "id string, uts long")
    results = spark.createDataFrame([("8", True), ("7", False)], "id string, success boolean")
    got = reconcile.bulk_delete(plays, results)
    assert [(r.number, r.id, r.status) for r in got.orderBy("number").collect()][:3] == [(1, "8", "deleted"), (2, "7", "failed"), (3, "6", "pending")]
    assert [r.number for r in got.orderBy(F.desc("uts")).collect()] == list(range(1, 10))
    assert rows_of(reconcile.delete_report(got)) == [(9, 1, 1)]


def test_texts(spark):
    assert texts.parse_range("3-10") == (3, 10) and texts.parse_time("12") == 12 and texts.parse_time("2024-01-01") == 1704067200
    for bad in ("10-3", "3", "a-b", "-1-3", "1-2-3"):
        with pytest.raises(ValueError):
            texts.parse_range(bad)
    df = spark.createDataFrame([("12",), ("2024-01-01",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.time_of(F.col("t"))).collect()] == [12, 1704067200, None, None]
    one = spark.range(1).select(texts.time_text(F.lit(1704067201)), texts.edit_id(F.lit(5), F.lit("op"), F.lit(7))).first()
    assert one[0] == "2024-01-01 00:00:01" and one[1].startswith("e5-") and one[1].endswith("-7") and len(one[1]) == 13
    assert state.safe_name("a b/ü-1_") == "a_b_ü-1_"


def test_guards(spark):
    intents = spark.createDataFrame([("a", "awaiting_approval", False), ("r", "ready", False), ("x", "rejected", True), ("y", "rejected", False), ("d", "applied", False)], "id string, state string, dismissed boolean")
    asked = [("a", "approve", False), ("r", "approve", False), ("r", "reject", True), ("a", "reject", False), ("x", "reinstate", False), ("y", "reinstate", False), ("d", "reject", True), ("no", "approve", False)]
    requests = spark.createDataFrame([(i, op, 9, d) for i, op, d in asked], "id string, op string, at long, dismiss boolean")
    got = {(r.id, r.op): (r.event, r.dismiss, r.dismissed, r.error) for r in eventlog.guarded(requests, intents).collect()}
    assert got == {
        ("a", "approve"): ("approved", None, None, None), ("r", "approve"): (None, None, None, "can't approve what is ready"), ("r", "reject"): ("rejected", True, True, None), ("a", "reject"): ("rejected", False, None, None),
        ("x", "reinstate"): ("reinstated", None, False, None), ("y", "reinstate"): ("reinstated", None, None, None), ("d", "reject"): (None, None, None, "can't reject what is applied"), ("no", "approve"): (None, None, None, "not found"),
    }
    proposals = spark.createDataFrame([("p", "pending"), ("q", "approved")], "id string, state string")
    asked = spark.createDataFrame([("p", "approve", 1), ("q", "reject", 1), ("z", "reject", 1)], "id string, op string, at long")
    assert {r.id: (r.event, r.joins, r.error) for r in eventlog.guarded_rules(asked, proposals).collect()} == {"p": ("approved", True, None), "q": (None, False, "is approved"), "z": (None, False, "not found")}


def test_guards_see_the_decisions_before(spark):
    """Random requests, each against the state after those before it, as one loop would have it."""
    import random

    rng = random.Random(6)
    states = ["awaiting_approval", "ready", "in_progress", "rejected", "applied", "abandoned"]
    intents = [(k, states[k % 6], k % 4 == 0, k % 6 == 3 and k % 2 == 0) for k in range(60)]
    asked = [(k % 62, rng.choice(["approve", "reject", "reinstate"]), at, rng.random() < 0.5) for at, k in enumerate(rng.choices(range(62), k=900))]
    now, want = {k: [s, a, w] for k, s, a, w in intents}, {}
    for k, op, at, dismiss in asked:
        found = now.get(k)
        allowed = found and found[0] in eventlog.GUARDS[op][0]
        entry = None
        if allowed:
            entry = (True if dismiss else None) if op == "reject" else False if op == "reinstate" and found[2] else None
            found[0] = {"approve": "ready", "reject": "rejected", "reinstate": "awaiting_approval" if found[1] else "ready"}[op]
            found[2] = dismiss if op == "reject" else False if op == "reinstate" else found[2]
        want[at] = (eventlog.GUARDS[op][1] if allowed else None, entry)
    df = spark.createDataFrame(intents, "id long, state string, requires_approval boolean, dismissed boolean")
    got = eventlog.guarded(spark.createDataFrame(asked, "id long, op string, at long, dismiss boolean").repartition(5), df)
    assert {r.at: (r.event, r.dismissed) for r in got.collect()} == want
    twice = spark.createDataFrame([("p", op, at) for at, op in enumerate(["reject", "approve", "reject"])], "id string, op string, at long")
    told = eventlog.guarded_rules(twice, spark.createDataFrame([("p", "pending")], "id string, state string"))
    assert [(r.event, r.joins, r.error) for r in told.orderBy("at").collect()] == [("rejected", False, None), (None, False, "is rejected"), (None, False, "is rejected")]


def test_delays(spark):
    df = spark.createDataFrame([(0, None), (2, 10), (9, None)], "n int, asked long")
    assert [r[0] for r in df.select(eventlog.retry_delay(F.col("n"), F.col("asked"))).collect()] == [30, 130, 600]


def test_edits(spark):
    df = spark.createDataFrame([("t", "al", "ar", None, 5)], "track string, album string, artist string, album_artist string, timestamp long")
    one = df.select(
        subjects.no_op_edit().alias("n"), subjects.with_artist(subjects.track_edit(F.col("track"), F.col("artist"), F.col("album"), F.col("timestamp")), F.lit("new")).alias("w"),
        subjects.artist_edit(F.col("artist"), F.lit("b")).alias("a"), subjects.album_edit(F.col("album"), F.col("artist"), F.lit("b")).alias("b"),
    )
    r = one.first()
    assert r.n.original_track == r.n.new_track == "t" and r.n.new_album_artist is None and r.w.new_album_artist == "new" and r.w.original_album_artist is None
    assert (r.a.original_track, r.a.new_album_artist) == (None, "b") and (r.b.original_album_artist, r.b.new_album_artist) == ("ar", None)
    said = one.select(*[subjects.summary_text(F.col(c)).alias(c) for c in "nwab"]).first()
    assert said.n == "no changes" and said.w == "artist: 'ar' -> 'new'; album artist: - -> 'new'" and said.a == "artist: 'ar' -> 'b'; album artist: - -> 'b'" and said.b == "artist: 'ar' -> 'b'; album artist: 'ar' -> -"


def test_reports(spark):
    intents = spark.createDataFrame([("ready",), ("ready",), ("report",), ("awaiting_approval",)], "outcome string")
    assert tuple(planner.plan_report(spark.range(7), intents, spark.range(2)).first()) == (7, 4, 2, 1, 1, 2)
    outcomes = spark.createDataFrame([("completed",), ("open",)], "outcome string")
    assert tuple(planner.execution_report(outcomes, spark.createDataFrame([("applied",), ("failed",), ("failed",)], "status string")).first()) == (2, 1, 0, 1, 2)
    appended = spark.createDataFrame([("new",), ("unchanged",)], "outcome string")
    assert tuple(reconcile.verify_report(spark.range(5), appended, spark.range(3)).first()) == (5, 1, 3)


def test_feed_of_uncovered_work(spark):
    plays = spark.createDataFrame([(k,) for k in (5, 15, 25, 35)], "uts long")
    schema = "start long, `end` long, verified_at long"
    synced, coverage = spark.createDataFrame([(0, 30, 0)], schema), spark.createDataFrame([("p", 0, 10, 0), ("q", 0, 20, 0)], "provider string, " + schema)
    assert sorted(r.uts for r in planner.feed(plays, synced, coverage, 0, 100).collect()) == [15, 25]


def test_queries_with_limits(spark):
    plays = spark.createDataFrame([("1", 5, "A", "x"), ("2", 15, "A", None), ("3", 25, "B", "x")], "id string, uts long, artist string, album string")
    assert [r.id for r in query.artist_plays(plays, "A", 10, 20).collect()] == ["2"]
    assert sorted(r.id for r in query.album_plays(plays, "x").collect()) == ["1", "3"]
    assert query.limited(plays, 0).count() == 3 and query.limited(plays, 2).count() == 2
    states = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "id string, updated_at long")
    assert [r.id for r in query.latest_first(states).collect()] == ["b", "c", "a"]
    assert query.pages_between(spark.createDataFrame([(k,) for k in range(5)], "page_number int"), 1, 3).count() == 3


def test_windows_of_the_service(spark):
    assert pages.api_window(10, 20) == (9, 20) and pages.api_window(0, None) == (0, None) and pages.api_window(None, 5) == (None, 5)
    rows = spark.createDataFrame([(5,), (10,), (None,), (1,)], "timestamp long")
    assert sorted(str(r[0]) for r in pages.clip_to_pin(rows, 10).collect()) == ["1", "5", "None"] and pages.clip_to_pin(rows, None).count() == 4
    assert sorted(r[0] for r in pages.until_stop(rows.filter("timestamp is not null"), 1).collect()) == [5, 10]
    form = spark.range(1).select(pages.form_text(F.create_map(F.lit("b"), F.lit("x y&"), F.lit("a"), F.lit(None).cast("string"))).alias("f"))
    assert form.first().f == "a=&b=x+y%26"


def test_too_many_requests(spark):
    rows = [("Slow Down by The Tram", 200, False), ("You're requesting a LOT of pages", 200, True), ("please Slow Down", 503, True), ("try again later", 503, False), (None, 429, True), ("ok", 404, False), ("my phrase", 500, False)]
    df = spark.createDataFrame([(b, s) for b, s, _ in rows], "b string, s int")
    assert [r[0] for r in df.select(pages.rate_limited(F.col("b"), F.col("s"))).collect()] == [w for _, _, w in rows]
    assert [r[0] for r in df.select(pages.rate_limited(F.col("b"), F.col("s"), ["My Phrase"], by_status=False, by_phrase=False)).collect()] == [False] * 6 + [True]


REL = "key string, id string, title string, date string, country string, disambiguation string, status string, primary_type string, pos long"


def rel(spark, *rows, credit="Someone"):
    return spark.createDataFrame([tuple(r) for r in rows], REL).withColumns({"artist_credit": F.array(F.lit(credit)), "secondary_types": F.array().cast("array<string>")})


def test_best_release(spark):
    df = rel(spark, ("k", "jp", "Tram", "1990", "JP", None, None, "Album", 0), ("k", "us", "Tram", "1995", "US", None, None, "Album", 1), ("k", "old", "Ferry", "1980", "GB", None, None, "Album", 2), ("k", "none", "Bus", None, None, None, None, "Album", 3)).withColumn("album", F.lit("TRAM"))
    best = lambda **o: releases.best_release(df, ["key"], **o).first().id
    assert best() == "old" and best(album="album") == "us" and best(album="album", prefer_non_japanese=False) == "jp"
    assert releases.best_release(df.withColumn("album", F.lit("Nowhere")), ["key"], "album").first().id == "old"
    assert releases.best_release(df.filter("id = 'jp'"), ["key"]).first().id == "jp"


def test_names_of_various_artists(spark):
    df = spark.createDataFrame([(c,) for c in ("VA", "v/a", "Various", "Various Artists", "Vade")], "c string")
    assert [r[0] for r in df.select(releases.various_artists(F.array("c"))).collect()] == [True, True, True, True, False]
    lists = spark.createDataFrame([("2011 Remaster", "x"), ("legacy", "x"), ("limited", "LIMITED")], "d string, t string")
    got = [tuple(r) for r in lists.select(releases.catalogue_edition(F.col("d")), releases.special_edition(F.col("d")), releases.special_title(F.col("t"))).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True)]
    st = spark.createDataFrame([("Official", "A"), (None, "A"), ("Bootleg", "A"), ("Official", "VA")], "s string, c string")
    assert [tuple(r) for r in st.select(releases.eligible(F.array("c"), F.col("s"), True), releases.unofficial(F.col("s"))).collect()] == [(True, False), (True, False), (False, True), (False, False)]


def test_track_exists(spark):
    rows = rel(spark, ("", "r1", "Harbour", "1990", "US", None, None, "Album", 0), ("", "r2", "Harbour", "1991", "US", "deluxe", None, "Album", 1)).withColumn("artist", F.lit("The Lamp Posts")).drop("key")
    contents = spark.createDataFrame([("r1", "Ferry"), ("r2", "Bonus")], "release_id string, title string")
    recordings = spark.createDataFrame([("The Lamp Posts", "Tram")], "artist string, title string")
    tracks = spark.createDataFrame([(1, "the lamp posts", "FERRY", "harbour"), (2, "The Lamp Posts", "Bonus", "Harbour"), (3, "The Lamp Posts", "tram", None), (4, "Nobody", "Tram", None), (5, "Nobody", "Ferry", "Harbour")], "id long, artist string, title string, album string")
    assert {r.id: r.exists for r in releases.track_exists(tracks, rows, contents, recordings).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_corrections(spark):
    tracks = spark.createDataFrame([(1, "A ", "t", "x"), (2, "a", "t", None), (3, "A", "t", "y")], "id long, artist string, name string, album string")
    found = spark.createDataFrame([(1, "A", "t", "x "), (2, "A", "t", "x"), (3, "A", "T", None)], "id long, m_artist string, m_title string, m_album string")
    got = {r.id: tuple(r)[1:] for r in releases.corrections(tracks, found).collect()}
    assert got == {1: ("no_action", "A ", "t", "x ", False), 2: ("edit", "A", "t", "x", False), 3: ("edit", "A", "T", "y", False)}


def test_albums_by_name_and_moves_off_compilations(spark):
    df = rel(spark, ("k", "1", "Harbour", "1990", "US", None, None, "Album", 0), ("k", "2", "Harbour", "1990", "US", None, None, "Album", 1), ("k", "3", "Harbours", "1990", "US", None, None, "Album", 2), ("k", "4", "Harbour", "1990", "US", None, "Bootleg", "Album", 3), ("k", "5", "qqq", "1990", "US", None, None, "Album", 4))
    named = releases.albums_named(df.withColumns({"a": F.lit("someone"), "b": F.lit("harbour")}), ["key"], "a", "b", 0.8)
    assert [(r.place, r.release_id, round(r.confidence, 3)) for r in named.orderBy("place").collect()] == [(0, "1", 1.0), (1, "3", 0.906)]
    moves = releases.off_compilations(df.withColumn("album", F.when(F.col("key") == "k", "Hits")), ["key"], "album")
    assert rows_of(moves) == [("k", "Harbour", True)]
    assert releases.off_compilations(df.withColumn("album", F.lit(None).cast("string")), ["key"], "album").count() == 0
    assert releases.off_compilations(df.withColumn("album", F.lit("HARBOUR")), ["key"], "album").count() == 0


def test_discovery(spark):
    library = spark.createDataFrame([("A", "t", "x", "A"), ("A", "t", "y", "VA"), ("A", "u", "x", "A"), ("B", "t", None, None)], "artist string, track string, album string, album_artist string")
    asked = [("all", "A", None, None, None, "N"), ("track", "A", "t", None, None, "N"), ("album", "A", None, "x", None, "N"), ("exact", "A", "t", "y", None, "N"), ("none", "A", "t", "zz", None, "N"), ("va", "A", None, None, "VA", None), ("lost", "Z", None, None, None, "N")]
    edits = spark.createDataFrame(asked, "edit_id string, artist string, track string, album string, album_artist string, new_artist string")
    got = {}
    for r in reconcile.discover(edits, library).collect():
        got.setdefault(r.edit_id, set()).add((r.original_track, r.original_album, r.new_artist, r.new_album_artist, r.error))
    assert got == {
        "all": {("t", "x", "N", "A", None), ("t", "y", "N", "VA", None), ("u", "x", "N", "A", None)}, "track": {("t", "x", "N", "A", None), ("t", "y", "N", "VA", None)}, "album": {("t", "x", "N", "A", None), ("u", "x", "N", "A", None)},
        "exact": {("t", "y", "N", "VA", None)}, "none": {(None, None, None, None, "no such play")}, "va": {("t", "y", "A", "VA", None)},
    }
    assert reconcile.of_album_artist(reconcile.discover(edits, library), "VA").count() == 4
