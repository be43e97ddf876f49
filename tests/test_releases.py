"""Ranking of releases: narrow rows are sorted, and the gap rule compares only what it can decide."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from playlake.operators import releases
from playlake.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "key int, id string, title string, date string, country string, disambiguation string, status string, primary_type string, secondary_types array<string>, artist_credit array<string>, pos long"
STATUSES = ["Official", None, "Promotion", "Bootleg"]


def rows(n, seed, keys=4):
    rng = random.Random(seed)
    pick = rng.choice
    return [
        (pick(range(keys)), f"i{rng.randrange(n)}", pick(["A", "A (Deluxe)"]), pick(["1970", "1979-02-01", "1985", "1991", None, "x"]), "US", "", pick(STATUSES), pick(["Album", "Single", "EP", None]),
         pick([[], ["Live"], None]), pick([["Someone"], ["VA"], None]), k // 2)
        for k in range(n)
    ]


def in_order(found, most):
    """Release by release, each compared with all before it."""
    kinds = {"Album": 0, "EP": 1, "Single": 2}
    def facts(r):
        year = int(r[3][:4]) if r[3] and r[3][:4].isdigit() else None
        comp = bool(r[9] and "VA" in r[9]) or bool(r[9] is not None and r[8] and "Live" in r[8])
        return (STATUSES.index(r[6]) if r[6] != "Promotion" else 2, comp, "Deluxe" in r[2]), (kinds.get(r[7], 4 if r[7] is None else 4), year if year is not None else 10**9, r[10]), year
    def precedes(a, b):
        (ha, ra, ya), (hb, rb, yb) = facts(a), facts(b)
        if ha != hb:
            return ha < hb
        early = lambda x, y, u, v: x[7] == "Single" and y[7] == "Album" and u is not None and v is not None and u + 10 <= v
        return True if early(a, b, ya, yb) else False if early(b, a, yb, ya) else ra < rb
    held = []
    for x in sorted(found, key=lambda r: (facts(r)[0][0], r[10], r[1]))[:most]:
        at = max((k + 1 for k, e in enumerate(held) if not precedes(x, e)), default=0)
        held.insert(at, x)
    return [r[1] for r in held]


@pytest.mark.parametrize("most", [None, 15])
def test_gap_rule_against_one_by_one(spark, most):
    made = [(*r[:9], r[9] or ["Someone"], k) for k, r in enumerate(rows(240, 5))]
    once = {}
    for r in made:
        once.setdefault((r[0], r[1]), r)
    got = releases.ranked_with_gap(spark.createDataFrame(made, SCHEMA), ["key"], most).orderBy("key", "rank").collect()
    for key in range(4):
        own = [r for r in got if r["key"] == key]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r["id"] for r in own] == in_order([r for (k, _), r in once.items() if k == key], most)


def test_many_releases_without_such_pairs_are_sorted(spark):
    made = spark.range(8000).select(F.lit(1).alias("key"), F.col("id").cast("string").alias("id"), F.lit("A").alias("title"), F.concat(F.lit("19"), F.col("id") % 90 + 10).alias("date"), F.lit("Official").alias("status"),
                                    F.lit("Album").alias("primary_type"), F.array().cast("array<string>").alias("secondary_types"), F.array(F.lit("Someone")).alias("artist_credit"), F.col("id").alias("pos"))
    began = time.perf_counter()
    found = [int(r["id"]) for r in releases.ranked_with_gap(made, ["key"]).orderBy("rank").collect()]
    assert found == sorted(range(8000), key=lambda k: (k % 90, k)) and time.perf_counter() - began < 15


@pytest.mark.parametrize("query", [
    lambda d: releases.ranked(d, ["key"]).select("key", "id", "rank"),
    lambda d: releases.ranked_with_gap(d, ["key"], 20).select("key", "id", "rank"),
    lambda d: releases.replacement(d.withColumn("album", F.col("title")), ["key"], "album").select("key", "id", "title"),
])
def test_sorted_rows_are_narrow(spark, query):
    """What decides is worked out before the first sort: no lists of credits or types wait in its memory."""
    plan = query(spark.createDataFrame(rows(20, 1), SCHEMA))._jdf.queryExecution().sparkPlan().toString()
    below = plan[max(m.start() for m in re.finditer("Window ", plan)):]
    assert "Window" in plan and not re.search(r"Window .*(artist_credit|secondary_types|primary_type|status|date)#", plan)
    kept = next(line for line in below.splitlines()[1:] if "Project" in line)
    names = re.search(r"Project \[(.*)\]", kept).group(1)
    assert not re.search(r"(^|, )(artist_credit|secondary_types|primary_type|status|date)#\d+(, |$)", names)


def test_gap_query_ranks_all_releases_of_a_key(spark):
    """Parts stand in some thirty lines each: all of them are ranked."""
    found = QUERIES["release_rank_gap"](spark, DATA).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy(F.col("l_partkey").alias("key")).agg(F.countDistinct("l_orderkey", "l_linenumber").alias("n"))
    want = {r["key"]: r["n"] for r in lines.collect()}
    assert {r["key"]: (r["n"], r["last"]) for r in found.collect()} == {k: (n, n) for k, n in want.items()} and max(want.values()) > 20


@pytest.mark.parametrize("seed", range(3))
def test_gap_rule_across_batches(spark, seed):
    """Groups of one head that are longer and shorter than a batch, with places of arrival that several share."""
    rng = random.Random(seed)
    years = [["1970", "1980", "1990"], [str(y) for y in range(1960, 2020)], ["1979", "1980", "1990", None]]
    made = [(k, f"i{n}", "A", rng.choice(years[k % 3]), "US", "", rng.choice(["Official", None]), rng.choice(["Album", "Album", "Single", "EP"]), [], ["Someone"], n // 2) for k in range(6) for n in range(rng.choice([3, 40, 90]))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = releases.ranked_with_gap(spark.createDataFrame(made, SCHEMA), ["key"]).orderBy("key", "rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for key in range(6):
        own = [r for r in made if r[0] == key]
        assert [(r["id"], r["rank"]) for r in got if r["key"] == key] == [(i, n + 1) for n, i in enumerate(in_order(own, None))]


def test_gap_rule_for_a_key_of_many_releases(spark):
    """Time is in proportion to the releases: each would be compared with all before it otherwise."""
    n, kinds = 60_000, ["Album", "EP", "Single"]
    rng = random.Random(7)
    facts = [(rng.randrange(3), rng.randrange(1950, 2020)) for _ in range(n)]
    # Only the last release of a type and year can be the one that another is put behind.
    follow, last, own = [-1] * (n + 1), {}, []
    def fine(t, y, u, v):
        return not ((t == 2 and u == 0 and y + 10 <= v) or (not (t == 0 and u == 2 and v + 10 <= y) and (t, y) < (u, v)))
    for k, (t, y) in enumerate(facts):
        at = max((i for i, c in enumerate(own) if fine(t, y, *c)), default=-1)
        behind = last[own[at]] if at >= 0 else n
        follow[k], follow[behind] = follow[behind], k
        last[t, y] = k
        if at < 0 or own[at] != (t, y):
            had = own.index((t, y)) if (t, y) in own else -1
            own.insert(at + 1, (t, y))
            if had >= 0:
                own.pop(had)
    want, at = [], follow[n]
    while at >= 0:
        want.append(at)
        at = follow[at]
    made = spark.createDataFrame([(k, str(y), kinds[t]) for k, (t, y) in enumerate(facts)], "pos long, date string, primary_type string").select(
        F.lit(1).alias("key"), F.col("pos").cast("string").alias("id"), F.lit("A").alias("title"), "date", F.lit("Official").alias("status"), "primary_type",
        F.array().cast("array<string>").alias("secondary_types"), F.array(F.lit("Someone")).alias("artist_credit"), "pos")
    began = time.perf_counter()
    found = [int(r["id"]) for r in releases.ranked_with_gap(made, ["key"]).orderBy("rank").collect()]
    assert found == want and time.perf_counter() - began < 30


def test_limits_and_filters_leave_ranks_alone(spark):
    made = [("k", f"i{n}", "A" if n % 2 else "B", str(1970 + 7 * n % 40), "US", "", "Official", ["Album", "EP", "Single"][n % 3], [], ["Someone"], n) for n in range(40)]
    found = releases.ranked_with_gap(spark.createDataFrame(made, SCHEMA.replace("key int", "key string")), ["key"])
    ranks = {r["id"]: r["rank"] for r in found.collect()}
    assert len(ranks) == 40 and all(ranks[r["id"]] == r["rank"] for d in (found.filter("title = 'A'"), found.limit(5), found.filter("rank > 30")) for r in d.collect())
