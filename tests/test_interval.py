import numpy as np
import random

from playlake.operators import interval
from playlake.plans import planner, sync


def ranges(spark, rows, verified=0):
    return spark.createDataFrame([(a, b, v[0] if v else verified) for a, b, *v in rows], "start long, `end` long, verified_at long")


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_normalise_touching_gap_and_age(spark):
    assert pairs(interval.normalise(ranges(spark, [(10, 20), (20, 30)]))) == [(10, 30)]
    assert pairs(interval.normalise(ranges(spark, [(30, 50, 2), (10, 35, 1)]))) == [(10, 50)]
    assert interval.normalise(ranges(spark, [(10, 20, 100), (15, 30, 500)])).first().verified_at == 100
    assert pairs(interval.normalise(ranges(spark, [(5, 5)]))) == []


def test_changes(spark):
    held = ranges(spark, [(10, 20), (30, 40)])
    assert interval.insert_changes(held, ranges(spark, [(20, 30)])).first().asDict() == {"kind": "merged", "start": 10, "end": 40, "absorbed": 2}
    assert interval.insert_changes(held, ranges(spark, [(12, 15)])).count() == 0
    assert interval.insert_changes(held, ranges(spark, [(100, 101)])).first().kind == "created"
    assert interval.insert_changes(held, ranges(spark, [(35, 45)])).first().kind == "extended"
    got = {(r.start, r.kind) for r in interval.subtract_changes(ranges(spark, [(10, 20), (30, 40), (50, 60)]), ranges(spark, [(15, 55)])).collect()}
    assert got == {(10, "shrunk"), (30, "removed"), (50, "shrunk")}
    assert interval.subtract_changes(ranges(spark, [(10, 40)]), ranges(spark, [(20, 30)])).first().kind == "split"
    assert interval.subtract_changes(ranges(spark, [(10, 20)]), ranges(spark, [(20, 30)])).count() == 0


def test_gaps_and_covers(spark):
    held = ranges(spark, [(10, 20), (30, 40)])
    assert pairs(interval.gaps(held, 0, 50)) == [(0, 10), (20, 30), (40, 50)]
    assert not interval.covers(held, 10, 40).first().covered
    assert interval.covers(held, 15, 15).first().covered
    assert pairs(interval.union(ranges(spark, [(10, 30), (50, 60)]), ranges(spark, [(20, 55)]))) == [(10, 60)]
    assert interval.total(held).first().covered == 20
    assert [(r.start, r.end) for r in sync.next_gap(held, 0, 50).collect()] == [(40, 50)]


def test_random_model(spark):
    """Many maps at once, each against a list of seconds."""
    rng, left, right, model = random.Random(5), [], [], {}
    for key in range(150):
        seconds = {0: set(), 1: set()}
        for side, rows in ((0, left), (1, right)):
            for _ in range(rng.randint(1, 7)):
                a = rng.randint(0, 199)
                b = rng.randint(a + 1, 200)
                rows.append((key, a, b, 0))
                seconds[side] |= set(range(a, b))
        model[key] = seconds
    schema = "key long, start long, `end` long, verified_at long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for run, op in ((interval.union, set.__or__), (interval.intersect, set.__and__), (interval.subtract, set.__sub__)):
        got = {}
        for r in run(a, b, ["key"]).collect():
            assert r["start"] < r["end"]
            got.setdefault(r["key"], []).append((r["start"], r["end"]))
        for key, seconds in model.items():
            own = sorted(got.get(key, []))
            assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))
            assert {s for x, y in own for s in range(x, y)} == op(seconds[0], seconds[1])
    points = spark.createDataFrame([(k, s) for k in range(20) for s in range(200)], "key long, uts long")
    inside = {(r.key, r.uts) for r in interval.contains(points, a, ["key"], span=17).collect()}
    assert inside == {(k, s) for k in range(20) for s in model[k][0]}


def test_claims(spark):
    plays = spark.createDataFrame([(100, "1"), (200, "2"), (200, "3"), (300, "4")], "uts long, id string")
    got = [(r.claim_start, r.claim_end, r.n) for r in planner.claims(plays, 50, 400, 2).orderBy("batch").collect()]
    assert got == [(50, 201, 3), (201, 400, 1)]
    assert [(r.claim_start, r.claim_end, r.n) for r in planner.claims(plays, 10, 20, 2).collect()] == [(10, 20, 0)]


def test_incremental_work(spark):
    coverage = spark.createDataFrame([("p", 100, 200, 0), ("q", 100, 300, 0)], "provider string, start long, `end` long, verified_at long")
    assert pairs(interval.incremental_work(ranges(spark, [(100, 300)]), coverage, 0, 1000)) == [(200, 300)]
    claim = spark.createDataFrame([("p", 200, 300, 1), ("q", 300, 310, 1)], coverage.schema)
    assert {(r.provider, r.start, r.end) for r in planner.claimed(coverage, claim, ["q"]).collect()} == {("p", 100, 300), ("q", 100, 300)}
    assert planner.reset_coverage(coverage.withColumnRenamed("provider", "provider"), "a", "b", "p").count() == 1


def test_sync_pass(spark):
    from pyspark.sql import functions as F

    from playlake.schema import play_id

    now = 1_000_000
    upstream = [(1000 + 100 * i, "A", f"t{i}") for i in range(10)]

    def rows(part):
        df = spark.createDataFrame([(u, a, t, k) for k, (u, a, t) in enumerate(part)], "uts long, artist string, track string, seq long")
        return df.withColumns({"id": play_id("uts", "artist", "track"), "album": F.lit(None).cast("string"), "fetched_at": F.lit(now).cast("long"), "deleted": F.lit(False), "month": F.date_format(F.timestamp_seconds("uts"), "yyyy-MM")})

    def pages(count):
        found = None
        for page in range(1, count + 1):
            part = rows(sorted(upstream, reverse=True)[(page - 1) * 3 : page * 3]).withColumns({"page_number": F.lit(page), "total_pages": F.lit(4)})
            found = part if found is None else found.unionByName(part)
        return found

    empty = ranges(spark, [(0, 0)]).limit(0)
    fresh, coverage = sync.sync_pass(pages(4), rows(upstream).limit(0), empty, 0, now)
    assert fresh.count() == 10 and pairs(coverage) == [(0, now - 60)]
    again, _ = sync.sync_pass(pages(4), rows(upstream), coverage, 0, now)
    assert again.count() == 0
    _, partial = sync.sync_pass(pages(2), rows(upstream), empty, 0, now)
    assert pairs(partial) == [(1401, now - 60)]
    # Pages behind the first that reaches below the start aren't read.
    fresh, coverage = sync.sync_pass(pages(4), rows(upstream).limit(0), empty, 1450, now)
    assert sorted(r.uts for r in fresh.collect()) == [1500, 1600, 1700, 1800, 1900] and pairs(coverage) == [(1450, now - 60)]
    assert sorted({r.page_number for r in sync.pass_rows(pages(4), 1450).collect()}) == [1, 2]
    assert tuple(sync.sync_report(pages(4), rows(upstream[:4]), ranges(spark, [(0, 500)]), 0, now).first()) == (4, 6, 0, 4, now - 60 - 500)
    assert sync.sync_pass(pages(4), rows(upstream), empty, now, now)[0].count() == 0


def test_subtraction_keeps_times(spark):
    schema = "start long, `end` long, verified_at long"
    held = spark.createDataFrame([(0, 100, 7), (200, 300, 5), (300, 320, 4)], schema)
    gone = spark.createDataFrame([(10, 20), (20, 30), (290, 310)], "start long, `end` long")
    assert sorted(tuple(r) for r in interval.subtract(held, gone).select("start", "end", "verified_at").collect()) == [(0, 10, 7), (30, 100, 7), (200, 290, 4), (310, 320, 4)]
    untimed = interval.subtract(held.drop("verified_at"), gone)
    assert untimed.columns == ["start", "end"] and untimed.count() == 4
    single = spark.createDataFrame([(0, 100, 7), (150, 200, 3), (400, 500, 1)], schema)
    changes = {(r.start, r.end): (r.kind, r.pieces) for r in interval.subtract_changes(single, spark.createDataFrame([(10, 20), (150, 200), (450, 600)], "start long, `end` long")).collect()}
    assert changes == {(0, 100): ("split", 2), (150, 200): ("removed", 0), (400, 500): ("shrunk", 1)}


def test_sync_order(spark):
    held = ranges(spark, [(100, 200), (300, 400)])
    assert [(r.start, r.end) for r in sync.fill_order(held, 0, 500).orderBy("place").collect()] == [(400, 500), (200, 300), (0, 100)]
    assert [tuple(r) for r in sync.extend_window(held, 50, 1000).collect()] == [(400, 940)]
    assert [tuple(r) for r in sync.extend_window(held.limit(0), 50, 1000).collect()] == [(50, 940)]
    assert sync.extend_window(held, None, 460).count() == 0
    left, changes = sync.invalidate(held, 150, 350)
    assert pairs(left) == [(100, 150), (350, 400)] and changes.count() == 2
    plays = spark.createDataFrame([(70,), (60,)], "uts long")
    assert [r[0] for r in sync.history_start(plays, None, 0, True).collect()] == [60]
    assert sync.history_start(plays, 5, 0, True).count() == sync.history_start(plays, None, 1, True).count() == sync.history_start(plays.limit(0), None, 0, True).count() == 0


def test_claims_by_key(spark):
    rng = np.random.default_rng(4)
    plays = [(int(k), int(t)) for k, t in zip(rng.integers(0, 6, 500), rng.integers(0, 90, 500), strict=True)]
    got = {}
    for r in planner.claims(spark.createDataFrame(plays, "key long, uts long"), 10, 80, 7, ["key"]).orderBy("key", "batch").collect():
        got.setdefault(r.key, []).append((r.batch, r.claim_start, r.claim_end, r.n))
    for key in range(6):
        want, batch, begin, n, last = [], 0, 10, 0, None
        for t in range(10, 80):
            here = plays.count((key, t))
            if not here:
                continue
            if n >= 7:
                want.append((batch, begin, last + 1, n))
                batch, begin, n = batch + 1, last + 1, 0
            n, last = n + here, t
        assert got[key] == [*want, (batch, begin, 80, n)]
