"""Keyed state: shuffled, repeated and late batches and a restart give the view that one batch gives."""

import random

from pyspark.sql import functions as F

from playlake.operators.store import current
from playlake.schema import PLAY, month_of
from playlake.streaming.merge import View
from playlake.streaming.winners import merge_winners

UTS = 1_705_312_800
DAY = 86400


def rows_of(seed, n, first_day, last_day):
    rng, out = random.Random(seed), []
    for k in range(n):
        i = rng.randrange(25)
        aa = None if k % 4 == 0 else ("verified", f"aa{k}") if k % 4 == 1 else ("unknown", None)
        out.append((f"{UTS + i * 3600}-{i:08x}", UTS + i * 3600, "A", f"t{i}", None if k % 3 else f"al{k}", aa, "api", UTS + DAY * rng.randrange(first_day, last_day), k % 11 == 0, 1, seed * 1000 + k))
    return out


def test_winners(spark, tmp_path):
    log, view, checkpoint = (str(tmp_path / n) for n in ("log", "view", "cp"))
    batches = [rows_of(1, 60, 0, 10), rows_of(2, 60, 5, 15), rows_of(1, 60, 0, 10), rows_of(3, 50, 0, 20), rows_of(2, 60, 5, 15), rows_of(4, 40, 10, 30)]
    everything, states = [], []
    for k, batch in enumerate(batches):
        random.Random(k).shuffle(batch)
        everything += batch
        df = spark.createDataFrame(batch, PLAY)
        df.repartition(2).write.mode("append").json(log)
        progress = merge_winners(spark, log, view, checkpoint, "60 days").recentProgress  # each a query of its own: a restart
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1])
        want = current(spark.createDataFrame(everything, PLAY).withColumn("month", month_of("uts")))
        told = lambda df: sorted((r.id, r.track, r.album, r.album_artist, r.fetched_at, r.deleted, r.seq) for r in df.collect())
        assert [str(t) for t in told(View(spark, view).read())] == [str(t) for t in told(want)]
    assert max(states) <= 2 * 25, states  # Spark counts a key twice in some batches
    version = View(spark, view).version()
    spark.createDataFrame(batches[0], PLAY).write.mode("append").json(log)
    merge_winners(spark, log, view, checkpoint, "60 days")
    assert View(spark, view).version() == version  # nothing wins, nothing is written


def test_state_goes_with_the_watermark(spark, tmp_path):
    log, view, checkpoint = (str(tmp_path / n) for n in ("log", "view", "cp"))

    def add(rows):
        spark.createDataFrame(rows, PLAY).coalesce(1).write.mode("append").json(log)
        progress = merge_winners(spark, log, view, checkpoint, "1 day").recentProgress
        return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1]

    row = lambda i, day, seq: (f"{UTS}-{i:08x}", UTS, "A", f"t{i}", None, None, "api", UTS + DAY * day, False, 1, seq)
    assert add([row(i, 0, i) for i in range(20)]) == 20
    assert add([row(99, 50, 99)]) <= 21
    assert add([row(98, 60, 98)]) <= 2
    # A later observation of an id whose state has gone wins, as it must; one fetched before the watermark is late.
    add([row(3, 61, 200), row(4, 2, 201)])
    got = {r.id[-2:]: r.fetched_at for r in View(spark, view).read().filter(F.col("track").isin("t3", "t4")).collect()}
    assert got == {"03": UTS + DAY * 61, "04": UTS}
