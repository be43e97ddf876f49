import os
import random

import pytest
from pyspark.sql import functions as F

from playlake.operators import store
from playlake.schema import PLAY, play_id
from playlake.sources.commits import PlayLog

JAN, FEB, MAR = 1705312800, 1707991200, 1710496800


def batch(spark, rows, seq=0):
    """(uts, track, album, fetched_at, deleted) → observations in order of arrival."""
    found = spark.createDataFrame([(*r, seq + k) for k, r in enumerate(rows)], "uts long, track string, album string, fetched_at long, deleted boolean, seq long")
    found = found.withColumns({"artist": F.lit("A"), "source": F.lit("api"), "v": F.lit(1), "album_artist": F.lit(None).cast(PLAY["album_artist"].dataType)})
    return found.withColumn("id", play_id("uts", "artist", "track")).withColumn("foreign", F.lit(1))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def view(rows):
    return sorted(map(tuple, store.current(rows).select("id", "album", "fetched_at", "deleted").collect()))


def test_outcomes_and_rows_by_one_write(spark, tmp_path):
    log = PlayLog(spark, str(tmp_path))
    first = batch(spark, [(JAN, "x", "a", 1, False), (JAN, "x", "a", 1, False), (FEB, "y", None, 1, False), (None, "z", None, 1, False)])
    assert log.append(first) == {"new": 2, "updated": 0, "unchanged": 1}
    assert log.append(first) == {"new": 0, "updated": 0, "unchanged": 3} and log.versions() == [1]
    second = batch(spark, [(JAN, "x", "b", 2, False), (JAN, "x", "c", 1, False), (MAR, "y", None, 1, True)], 10)
    assert log.append(second) == {"new": 1, "updated": 1, "unchanged": 1} and log.commit().stats["updated"] == 1
    assert log.append(first.limit(0)) == {"new": 0, "updated": 0, "unchanged": 0} and log.read().count() == 4
    assert sorted(log.commit().months) == ["2024-01", "2024-02", "2024-03"] and log.read(months=["2024-01"]).count() == 2
    assert not [f for f in files(tmp_path) if "unchanged" in f]


def test_random_batches_agree_with_the_classes(spark, tmp_path):
    rng, log, every = random.Random(4), PlayLog(spark, str(tmp_path)), None
    for k in range(3):
        rows = [(rng.choice([JAN, FEB, MAR]) + 60 * rng.randrange(6), rng.choice("xy"), rng.choice([None, "a"]), rng.randrange(4), rng.random() < 0.2) for _ in range(60)]
        new = batch(spark, rows, 100 * k).withColumn("month", F.date_format(F.timestamp_seconds("uts"), "yyyy-MM"))
        held = log.read()
        want = store.append_stats(held, new).first()
        assert log.append(new) == {"new": want["n_new"], "updated": want["n_updated"], "unchanged": want["n_unchanged"]}
        every = new if every is None else every.unionByName(new)
        if k == 1:
            log.compact()
    assert [r[:4] for r in view(log.read())] == [r[:4] for r in view(every)]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    log = PlayLog(spark, str(tmp_path))
    log.append(batch(spark, [(JAN, "x", "a", 1, False)]))
    broken = batch(spark, [(JAN + 60, "x", "a", 1, False), (FEB, "x", "a", 1, False)], 5).withColumn("album", F.when(F.col("uts") == FEB, F.raise_error(F.lit("torn")).cast("string")).otherwise(F.col("album")))
    with pytest.raises(Exception, match="torn"):
        log.append(broken)
    assert log.versions() == [1] and log.read().count() == 1

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        log.append(batch(spark, [(MAR, "x", "a", 1, False)], 9), before_commit=dies)
    assert log.versions() == [1] and log.read().count() == 1
    log.vacuum()
    assert len(files(tmp_path)) == 1


def test_compaction_rewrites_redundant_months_only(spark, tmp_path):
    log = PlayLog(spark, str(tmp_path))
    log.append(batch(spark, [(JAN, "x", "a", 1, False), (FEB, "x", "a", 1, False), (MAR, "x", "a", 1, False)]))
    log.append(batch(spark, [(FEB, "x", "b", 2, False), (FEB + 60, "x", None, 2, False), (MAR, "x", "a", 2, True)], 10))
    before, seen, counts = log.commit(), view(log.read()), sorted(map(tuple, store.compact_counts(log.read()).collect()))
    told = sorted(map(tuple, log.compact().collect()))
    assert [r[:4] for r in told] == counts and [(r[0], r[4]) for r in told] == [("2024-01", False), ("2024-02", True), ("2024-03", True)]
    after = log.commit()
    assert after.months["2024-01"] == before.months["2024-01"] and not set(after.months["2024-02"]) & set(before.months["2024-02"])
    assert view(log.read()) == seen and log.read().count() == 4 and log.read(before).count() == 6
    assert {r["rewritten"] for r in log.compact().collect()} == {False} and log.commit().version == after.version
    log.append(batch(spark, [(JAN + 60, "x", "a", 1, False)], 20))
    assert [r["month"] for r in log.compact(most_folders=1).collect() if r["rewritten"]] == ["2024-01"]
    log.vacuum(keep=1)
    assert log.read().count() == 5 and log.versions() == [log.commit().version]


def test_appends_and_compactions_side_by_side(spark, tmp_path):
    log, other = PlayLog(spark, str(tmp_path)), PlayLog(spark, str(tmp_path))
    log.append(batch(spark, [(JAN, "x", "a", 1, False), (FEB, "x", "a", 1, False)]))
    log.append(batch(spark, [(JAN, "x", "b", 2, False)], 5))
    # An append into the very month that is being rewritten stays.
    log.compact(before_commit=lambda: other.append(batch(spark, [(JAN, "x", "c", 3, False), (JAN + 60, "x", "a", 1, False)], 10)))
    assert [r[1] for r in view(log.read(months=["2024-01"]))] == ["c", "a"] and log.read(months=["2024-01"]).count() == 3
    # A compaction during an append doesn't change the append's outcomes.
    assert log.append(batch(spark, [(JAN, "x", "d", 4, False)], 20), before_commit=other.compact) == {"new": 0, "updated": 1, "unchanged": 0}
    assert log.read(months=["2024-01"]).count() == 3 and view(log.read())[0][1] == "d"
    # An append of the same rows by another writer does.
    rows, calls = batch(spark, [(MAR, "x", "a", 1, False)], 30), []

    def first():
        if not calls:
            calls.append(other.append(rows))

    assert log.append(rows, before_commit=first) == {"new": 0, "updated": 0, "unchanged": 1} and calls == [{"new": 1, "updated": 0, "unchanged": 0}]
    # Of two compactions one wins, the other finds nothing left.
    log.append(batch(spark, [(FEB, "x", "z", 9, False)], 40))
    log.compact(before_commit=other.compact)
    assert log.read().count() == 4 and [c.kind for c in log._since(0)].count("compact") == 3
