"""Planning passes and rounds of continuous mode."""

from pyspark.sql import functions as F

from playlake.plans import passes
from playlake.schema import album_artist_of, play_id
from playlake.sources import state
from playlake.streaming.merge import View

NOW = 1_700_100_000
RULES = [{"track_name": {"find": "^tram (\\d)$", "replace": "Tram $1"}, "name": "spell"}, {"album_name": {"find": "^demo$", "replace": "Demo"}, "requires_confirmation": True}]


def pages(spark, rows, fetched):
    """(uts, artist, track, album) → pages of three of the service, the newest first."""
    ordered = sorted(rows, reverse=True)
    total = -(-len(ordered) // 3)
    df = spark.createDataFrame([(*r, k, k // 3 + 1, total) for k, r in enumerate(ordered)], "uts long, artist string, track string, album string, seq long, page_number int, total_pages int")
    return df.withColumns({"id": play_id("uts", "artist", "track"), "album_artist": album_artist_of(F.lit("api"), F.lit(None).cast("string")), "source": F.lit("api"), "fetched_at": F.lit(fetched).cast("long"), "deleted": F.lit(False), "v": F.lit(1), "month": F.date_format(F.timestamp_seconds("uts"), "yyyy-MM")})


def test_rounds(spark, tmp_path):
    path, start = str(tmp_path / "p"), 1_700_000_000
    state.save_rules(spark, path, RULES)
    rows = [(start + 100 * k, "A", f"tram {k}", None) for k in range(5)] + [(start + 1000, "A", "bus", "demo"), (start + 1100, "A", "tram 1", None)]
    report = lambda df: {r.outcome: (r.subjects, r.plays) for r in df.collect()}
    assert report(passes.cycle(spark, path, pages(spark, rows, NOW), start, NOW)) == {"ready": (5, 6), "awaiting_approval": (1, 1)}
    assert View(spark, f"{path}/view").read().count() == 7
    queue = state.read_events(spark, f"{path}/queue", passes.QUEUE)
    assert {(r.track, r.new_track, r.new_album, r.requires_approval) for r in queue.collect()} == {(f"tram {k}", f"Tram {k}", None, False) for k in range(5)} | {("bus", "bus", "Demo", True)}
    assert [(r.start, r.end) for r in state.load_coverage(spark, path, "rules").collect()] == [(start, NOW - 60)]
    # The same pages again: nothing is new, neither for the log nor for the rules.
    assert report(passes.cycle(spark, path, pages(spark, rows, NOW), start, NOW + 10)) == {}
    # A new play of an open subject makes no second intent; one of another subject does.
    more = [*rows, (NOW + 100, "A", "tram 2", None), (NOW + 200, "A", "tram 9", None)]
    assert report(passes.cycle(spark, path, pages(spark, more, NOW + 1000), start, NOW + 1000)) == {"ready": (1, 1)}
    assert View(spark, f"{path}/view").read().count() == 9
    # Other rules look at everything again.
    state.save_rules(spark, path, [*RULES, {"track_name": {"find": "^bus$", "replace": "Bus"}}, {"artist_name": {"find": "^A$", "replace": "Aa"}, "track_name": {"find": "^nothing$", "replace": "x"}}])
    state.append_events(queue.filter("track = 'bus'").limit(1).withColumns({"event": F.lit("rejected"), "seq": F.lit(NOW + 1500).cast("long")}), f"{path}/queue")
    assert report(passes.cycle(spark, path, pages(spark, more, NOW + 2000), start, NOW + 2000)) == {"awaiting_approval": (1, 1)}


def test_a_dry_run_claims_nothing(spark):
    schema = "start long, `end` long, verified_at long"
    plays = pages(spark, [(100, "A", "tram 1", None)], NOW)
    synced, nothing = spark.createDataFrame([(0, 200, 1)], schema), spark.createDataFrame([], schema)
    intents, events, after = passes.planning_pass(plays, state_rules(), synced, nothing, spark.createDataFrame([], passes.QUEUE), 0, 1000, NOW, dry_run=True)
    assert [r.outcome for r in intents.collect()] == ["report"] and events.count() == 0 and after.count() == 0


def state_rules():
    from playlake.functions.rules import rules_from_rows

    return rules_from_rows(RULES)
