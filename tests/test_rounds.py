"""Several providers in a pass, and rounds that are committed at once: broken off anywhere, and by two writers."""

import shutil

import pytest
from pyspark.sql import functions as F

from playlake.functions.rules import rules_from_rows, rules_hash
from playlake.plans import rounds as rounds_module
from playlake.plans.providers import Provider, by_catalogue, by_rules, off_compilations, plan_with, reported
from playlake.plans.rounds import QUEUE, Head, Rounds, run_round
from playlake.sources.state import StateFiles
from test_passes import NOW, RULES, pages

START = 1_700_000_000
COVERAGE = "provider string, start long, `end` long, verified_at long"


def plays_of(spark, rows):
    return pages(spark, rows, NOW).drop("page_number", "total_pages")


def rules():
    return by_rules(rules_from_rows(RULES))


def broken(how):
    def suggest(subjects):
        if how == "plan":
            raise RuntimeError("no catalogue today")
        boom = F.udf(lambda t: 1 // 0, "string")
        return subjects.withColumns({f"new_{f}": boom("track") for f in ("track", "album", "artist", "album_artist")}).withColumn("confirm", F.lit(False))

    return Provider("broken", suggest)


ROWS = [(START + 10, "A", "tram 1", "demo"), (START + 20, "A", "tram 1", "demo"), (START + 30, "B", "bus", "hits"), (START + 40, "C", "walk", None), (START + 50, "B", "tram 2", None)]


def catalogue(spark):
    return by_catalogue(spark.createDataFrame([("A", "tram 1", "A", "Tram One", None), ("C", "walk", "C ", "Walk", "Feet"), ("B", "bus", "B", "bus", None)], "artist string, track string, m_artist string, m_title string, m_album string"))


def compilations(spark):
    schema = "artist string, track string, album string, id string, title string, artist_credit array<string>, date string, country string, status string, disambiguation string, primary_type string, secondary_types array<string>, pos int"
    rows = [("B", "bus", "hits", "1", "hits", ["Various Artists"], "1999", None, "Official", None, "Album", ["Compilation"], 0), ("B", "bus", "hits", "2", "Wheels", ["B"], "1990", None, "Official", None, "Album", [], 1)]
    return off_compilations(spark.createDataFrame(rows, schema))


def passed(spark, tmp_path, providers, coverage=(), queue=(), **policy):
    synced = spark.createDataFrame([(START, START + 1000, 1)], "start long, `end` long, verified_at long")
    found = plan_with(plays_of(spark, ROWS), providers, synced, spark.createDataFrame(list(coverage), COVERAGE), spark.createDataFrame(list(queue), QUEUE), START, START + 100, NOW, str(tmp_path / "s"), **policy)
    told = {(r.artist, r.track): (r.provider, r.new_track, r.new_album, r.n, r.outcome) for r in found.intents.collect()}
    return found, told, sorted((r.provider, r.start - START, r.end - START) for r in found.coverage.collect())


def test_the_first_suggestion_of_a_subject_counts(spark, tmp_path):
    found, told, claims = passed(spark, tmp_path, [rules(), catalogue(spark), compilations(spark)])
    by_the_rules = {("A", "tram 1"): ("rules", "Tram 1", "Demo", 2, "awaiting_approval"), ("B", "tram 2"): ("rules", "Tram 2", None, 1, "ready")}
    assert told == by_the_rules | {("C", "walk"): ("catalogue", "Walk", "Feet", 1, "ready"), ("B", "bus"): ("compilations", "bus", "Wheels", 1, "awaiting_approval")}
    assert claims == [("catalogue", 0, 100), ("compilations", 0, 100), ("rules", 0, 100)] and found.failed == {}
    events = found.events.collect()
    assert len({e.id for e in events}) == 4 and {e.provider for e in events} == {"rules", "catalogue", "compilations"}
    beaten = reported(spark.read.parquet(str(tmp_path / "s" / "1")), found.intents).collect()
    assert [(r.track, r.provider, r.chosen) for r in beaten] == [("tram 1", "catalogue", "rules")]
    _, told, _ = passed(spark, tmp_path, [catalogue(spark), rules()])
    assert told["A", "tram 1"] == ("catalogue", "Tram One", "demo", 2, "ready") and told["B", "tram 2"][0] == "rules"


@pytest.mark.parametrize("how", ["plan", "task"])
def test_a_failure_withholds_its_own_claim(spark, tmp_path, how):
    found, told, claims = passed(spark, tmp_path, [broken(how), rules()])
    assert claims == [("rules", 0, 100)] and list(found.failed) == ["broken"] and len(told) == 2
    # Coverage that it had before stays.
    _, _, claims = passed(spark, tmp_path, [broken(how), rules()], [("broken", START, START + 5, 1)])
    assert claims == [("broken", 0, 5), ("rules", 0, 100)]


def test_each_provider_sees_what_is_new_to_it(spark, tmp_path):
    _, told, claims = passed(spark, tmp_path, [rules(), catalogue(spark)], [("rules", START, START + 15, 1), ("catalogue", START + 15, START + 100, 1)])
    assert told == {("A", "tram 1"): ("rules", "Tram 1", "Demo", 1, "awaiting_approval"), ("B", "tram 2"): ("rules", "Tram 2", None, 1, "ready")}
    assert claims == [("catalogue", 0, 100), ("rules", 0, 100)]
    found, told, claims = passed(spark, tmp_path, [rules()], dry_run=True)
    assert {t[-1] for t in told.values()} == {"report"} and claims == [] and found.events.count() == 0
    event = ("q", 1, 1, "created", "x", False, False, "B", "tram 2", None, None, *[None] * 4)
    assert set(passed(spark, tmp_path, [rules()], queue=[event])[1]) == {("A", "tram 1")}


class Killed(Exception):
    pass


def state_of(spark, path):
    rounds = Rounds(spark, path)
    head = rounds.head()
    queue = sorted(tuple(r) for r in rounds.queue(head).drop("id").collect()) if head.queue else []
    return queue, head.coverage, sorted((r.id, r.fetched_at, r.deleted) for r in rounds.view(head).collect()), sorted(r.id for r in rounds.log(head).collect())


def test_rounds_that_break_off(spark, tmp_path, monkeypatch):
    """Killed before any of its writes, or after the last, a round that is begun anew comes to the same."""
    more = [*ROWS, (NOW - 500, "A", "tram 7", None)]
    hashes = rules_hash(RULES)
    clean = str(tmp_path / "clean")

    def again(path):
        return run_round(spark, path, pages(spark, more, NOW + 9), [rules(), broken("plan")], START, NOW, hashes)

    run_round(spark, clean, pages(spark, ROWS, NOW), [rules()], START, START + 200, hashes)
    paths = [shutil.copytree(clean, tmp_path / f"at{k}") for k in range(4)]
    assert {r.outcome: r.subjects for r in again(clean).collect()} == {"ready": 1} and Rounds(spark, clean).head().facts["failed"].keys() == {"broken"}
    want = state_of(spark, clean)
    assert len(want[0]) == 3 and len(want[2]) == 6
    steps = []
    real_write, real_publish = Rounds.write, Rounds.publish

    def counting(real):
        def run(self, *args, **kwargs):
            if len(steps) == kill_at:
                steps.append("killed")
                raise Killed
            steps.append(real.__name__)
            return real(self, *args, **kwargs)
        return run

    kill_at = -1
    monkeypatch.setattr(Rounds, "write", counting(real_write))
    monkeypatch.setattr(Rounds, "publish", counting(real_publish))
    for kill_at, path in enumerate(map(str, paths)):  # before the log, the view, the queue, and the commit
        steps.clear()
        with pytest.raises(Killed):
            again(path)
        assert Rounds(spark, path).head().version == 1 and steps[-1] == "killed" and len(steps) == kill_at + 1
        again(path)
        assert state_of(spark, path) == want
    rounds = Rounds(spark, path)
    rounds.vacuum(1)
    head = rounds.head()
    assert state_of(spark, path) == want and rounds.versions() == [2]
    assert len(StateFiles(spark, f"{path}/log").names()) == len(head.log) == 2
    assert rounds.compact() and len(rounds.head().log) == 1 and state_of(spark, path) == want


def test_two_writers(spark, tmp_path):
    """A round whose commit comes second is begun anew from the first one's."""
    path, other = str(tmp_path / "p"), []

    def meanwhile(head):
        if not other:
            other.append(head.version)
            run_round(spark, path, pages(spark, ROWS[:2], NOW), [rules()], START, START + 85)

    run_round(spark, path, pages(spark, ROWS, NOW + 5), [rules()], START, START + 300, before_commit=meanwhile)
    head = Rounds(spark, path).head()
    assert other == [0] and head.version == 2 and len(head.log) == 2
    queue, coverage, view, _ = state_of(spark, path)
    assert len(view) == 5 and len({(q[6], q[7]) for q in queue}) == len(queue) == 2
    assert not Rounds(spark, path).publish(Head(1)) and Rounds(spark, path).head().version == 2
    with pytest.raises(RuntimeError):
        run_round(spark, path, pages(spark, ROWS, NOW + 6), [], START, START + 400, tries=1, before_commit=lambda h: Rounds(spark, path).publish(h))


def test_changed_rules_look_again(spark, tmp_path):
    path = str(tmp_path / "p")
    run_round(spark, path, pages(spark, ROWS, NOW), [rules()], START, START + 300, "one")
    more = by_rules(rules_from_rows([*RULES, {"track_name": {"find": "^bus$", "replace": "Bus"}}]))
    assert run_round(spark, path, pages(spark, ROWS, NOW), [more], START, START + 300, "one").count() == 0
    assert [r.subjects for r in run_round(spark, path, pages(spark, ROWS, NOW), [more], START, START + 300, "two").collect()] == [1]
    assert rounds_module.SYNCED in Rounds(spark, path).head().coverage
