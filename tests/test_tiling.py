"""Batches of one sequence cut in spans, and rules as a table, against one loop each."""

import random

import pytest
from pyspark.sql import functions as F

from playlake.functions.rule_table import apply_table, required
from playlake.functions.rules import FIELDS, Rule, apply_chain, rules_from_rows
from playlake.plans import planner
from playlake.plans.tiling import tiles


def one_loop(counted, start, end, hint):
    out, n, begin, last = [], 0, start, None
    for uts, k in sorted(counted.items()):
        if n >= hint:
            out.append((len(out), begin, last + 1, n))
            begin, n = last + 1, 0
        n, last = n + k, uts
    return [*out, (len(out), begin, end, n)]


@pytest.mark.parametrize("span", [1, 3, 17, 1000])
def test_spans_meet_without_a_seam(spark, span):
    rng = random.Random(span)
    for hint, size in ((1, 40), (5, 120), (7, 1), (50, 200), (3, 0)):
        counted = {rng.randrange(100, 400): rng.choice([1, 1, 2, 9]) for _ in range(size)}
        df = spark.createDataFrame(list(counted.items()), "uts long, n long").repartition(3)
        got = sorted(tuple(r[c] for c in ("batch", "claim_start", "claim_end", "n")) for r in tiles(df, 90, 500, hint, span).collect())
        assert got == one_loop(counted, 90, 500, hint)


def test_claims_with_and_without_keys_agree(spark):
    rng = random.Random(5)
    plays = spark.createDataFrame([(rng.randrange(0, 90 * 86400), 1) for _ in range(900)], "uts long, one int")
    columns = ("batch", "claim_start", "claim_end", "n")
    each = [sorted(tuple(r[c] for c in columns) for r in planner.claims(plays, 1000, 80 * 86400, 20, keys).collect()) for keys in ([], ["one"])]
    assert each[0] == each[1] and len(each[0]) > 30


RULES = [
    {"track_name": {"find": "^tram (\\d)$", "replace": "Tram $1"}, "name": "a"}, {"track_name": {"find": "Tram [13]", "replace": "odd"}, "artist_name": {"find": "a", "replace": "AA"}, "requires_confirmation": True},
    {"album_name": {"find": ".*", "replace": "all"}, "track_name": {"find": "odd", "replace": "$0!"}}, {"track_name": {"find": "(x)|(tram)", "replace": "$2$1"}}, {"album_name": {"find": "demo|all", "replace": "Demo"}, "requires_catalogue": True, "name": "c"},
    {"artist_name": {"find": "K\\.?", "replace": "kay", "flags": "i"}}, {"album_artist_name": {"find": ".*", "replace": "aa"}}, {"track_name": {"find": "bus", "replace": ""}},
]


@pytest.mark.parametrize("catalogue", [None, {"c": True}, {"c": False}])
def test_the_table_is_the_chain(spark, catalogue):
    rng = random.Random(1)
    rows = [tuple(rng.choice(v) for v in (["tram 1", "tram 2", "bus", "odd", "TRAM", "", None, "x tram"], ["demo", "hits", "", None], ["a", "b", "\u212a.", "kk", None], ["v", None])) for _ in range(120)]
    subjects = spark.createDataFrame(rows, "track string, album string, artist string, album_artist string")
    rules = rules_from_rows(RULES)
    told = lambda df: sorted((tuple(r[c] for c in (*FIELDS, *(f"new_{f}" for f in FIELDS), "confirm", "changed")) for r in df.collect()), key=str)
    assert told(apply_table(subjects, rules, catalogue)) == told(apply_chain(subjects, rules, catalogue))


def test_the_plan_does_not_grow(spark):
    rules = rules_from_rows([{"track_name": {"find": f"^t{k}$", "replace": f"T{k}"}} for k in range(2000)])
    subjects = spark.range(50).select(F.concat(F.lit("t"), (F.col("id") * 41).cast("string")).alias("track"), *(F.lit("z").alias(f) for f in FIELDS[1:]))
    out = apply_table(subjects, rules)
    assert len(out._jdf.queryExecution().executedPlan().toString().split("Project")) < 8
    assert {r.new_track for r in out.collect()} == {f"T{k}" if k < 2000 else f"t{k}" for k in range(0, 50 * 41, 41)}


@pytest.mark.parametrize(("find", "flags", "want"), [
    ("^track_3$", "", "track_3"), ("a|b", "", None), ("(a|b)cd+e", "", "cd"), ("ab?c", "", "a"), ("ab{0,2}c", "", "a"), (r"\d\.5 x", "", ".5 x"), ("[abc]def", "", "def"), (r"(?i)remaster", "", None), (r"\x41bc", "", None),
    ("Disk 42", "i", " 42"), ("GROOVE", "i", "groove"), ("(?:ab)cd", "", "cd"), (".*", "", None), ("ab+c", "", "ab"), (r"\(live\)", "", "(live)"), ("é!", "i", "!"), ("", "", None),
])
def test_required_text(find, flags, want):
    assert required(Rule(find, "", flags)) == want
