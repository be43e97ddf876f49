import pytest
from pyspark.sql import functions as F

from playlake.functions.rules import RewriteRule, Rule, any_rule, apply_chain, default_rules, rules_from_rows, rules_hash, without_pattern, without_suffixes

CASES = [
    (Rule(r"take (\d+)", "No. $1"), "Waltz, take 12 (live)", "No. 12"),
    (Rule(r"vs\.", "against"), "North vs. South", "against"),
    (Rule(r"(.+) w/ (.+)", "$1 with $2"), "Marta w/ Ivo", "Marta with Ivo"),
    (Rule(r"(?P<who>.+): (?P<what>.+)", "${what} of ${who}"), "Lamp Posts: Evening Tram", "Evening Tram of Lamp Posts"),
    (Rule(r"(?P<a>.+), UNPLUGGED", "${a}", "i"), "Ferry, unplugged", "Ferry"),
    (Rule(r" \(disc \d\)", ""), "Harbour", "Harbour"),
    (Rule(r" \(disc \d\)", ""), "Harbour (disc 2)", ""),
    (Rule(r"(a)|(b)", "[$1$2]"), "b", "[$1b]"),
    (Rule(r"(x)", "$10"), "x", "x0"),
    (Rule(r"(x)", r"\$1 $$1 \\ \{\}"), "x", "$1 $1 \\ {}"),
    (Rule(r"(.+)!(.+)", "$1$2"), "$2!z", "zz"),
    (Rule("ABC", "hit", "ic"), "abc", "abc"),
    (Rule("ABC", "hit", "ci"), "abc", "hit"),
    (Rule("^b", "hit"), "a\nb", "hit"),
    (Rule("^b", "hit", "e"), "a\nb", "a\nb"),
    (Rule("a.b", "hit", "s"), "a\nb", "hit"),
    (Rule("a.b", "hit"), "a\rb", "hit"),
    (Rule(r"^\w+$", "word"), "Füße", "word"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_whole_string(spark, k):
    rule, value, want = CASES[k]
    row = spark.createDataFrame([(value,), (None,)], "v string").select(rule.apply(F.col("v")).alias("o")).collect()
    assert [r.o for r in row] == [want, None]
    match = rule.compiled().search(value)
    assert (rule.expand(match) if match else value) == want


def test_dialect():
    with pytest.raises(ValueError):
        Rule("(?=x)", "").compiled()
    with pytest.raises(ValueError):
        Rule(r"(x)\1", "").java()


def test_missing_values(spark):
    df = spark.createDataFrame([("t", None, "a", None)], "track string, album string, artist string, album_artist string")
    any_album = RewriteRule({"album": Rule(".*", "x")})
    assert df.select(any_album.matches_edit()).first()[0]
    assert not df.select(RewriteRule({"album": Rule(".+", "x")}).matches_edit()).first()[0]
    assert df.select(RewriteRule({}).matches_track()).first()[0]
    out = apply_chain(df, [any_album]).first()
    assert out.new_album is None and not out.changed


def test_chain(spark):
    df = spark.createDataFrame([("one", None, "a", None), ("two", "al", "b", "b")], "track string, album string, artist string, album_artist string")
    chain = rules_from_rows([
        {"track_name": {"find": "^one$", "replace": "two"}, "name": "first"},
        {"track_name": {"find": "^two$", "replace": "three"}, "requires_confirmation": True},
        {"artist_name": {"find": "^a$", "replace": "A"}, "name": "asked", "requires_catalogue": True},
    ])
    got = {r.track: (r.new_track, r.new_artist, r.confirm) for r in apply_chain(df, chain, {"asked": False}).collect()}
    assert got == {"one": ("three", "a", True), "two": ("three", "b", True)}
    assert {r.track: r.new_artist for r in apply_chain(df, chain).collect()} == {"one": "A", "two": "b"}
    assert len(rules_hash([{"a": 1}])) == 64


def test_long_chain_stays_linear(spark):
    df = spark.createDataFrame([("t0", None, "a", None)], "track string, album string, artist string, album_artist string")
    chain = [RewriteRule({"track": Rule(f"^t{k}$", f"t{k + 1}")}) for k in range(30)]
    assert apply_chain(df, chain).first().new_track == "t30"


def test_suffixes(spark):
    rows = [
        ("Tram - 2009 Remaster", "Tram"), ("Tram (Remastered)", "Tram"), ("Tram [2011]", "Tram"), ("Tram \u2013 1998 mix of the year", "Tram"), ("Tram remastered 2004", "Tram"), ("Tram (1971) [Digitally Remastered]", "Tram"),
        ("Plain", "Plain"), ("Remastered", "Remastered"), ("Summer of 1969", "Summer of 1969"), ("Track (1234)", "Track (1234)"), ("Mixed feelings", "Mixed feelings"), ("(2001)", "(2001)"), (None, None),
    ]
    df = spark.createDataFrame(rows, "a string, want string").select("want", without_suffixes(F.col("a")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_catalogue_clean_up(spark):
    plays = spark.createDataFrame([("A", "Tram (demo)"), ("A", "Tram (demo)"), ("A", "(demo)"), ("A", "Ferry"), ("B", "Tram (demo)")], "artist string, track string")
    assert sorted(tuple(r) for r in without_pattern(plays, r"\(demo\)", "A").collect()) == [("A", "Tram (demo)", "Tram")]
    assert without_pattern(plays, r"\(demo\)").count() == 2


def test_default_rules_ignore_case(spark):
    chain = default_rules([{"track_name": {"find": "^TRAM$", "replace": "Ferry"}, "name": "a"}, {"track_name": {"find": "^BUS$", "replace": "x", "flags": "c"}}])
    df = spark.createDataFrame([("tram", None, "a", None), ("bus", None, "a", None)], "track string, album string, artist string, album_artist string")
    assert {r.track: (r.new_track, r.changed) for r in apply_chain(df, chain).collect()} == {"tram": ("Ferry", True), "bus": ("bus", False)}
    assert {r.track: r[1] for r in df.select("track", any_rule(chain)).collect()} == {"tram": True, "bus": False}
