"""The registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playlake.folders import new_folder
from playlake.functions import rules
from playlake.operators import eventlog, interval, query, reconcile, releases, store, subjects
from playlake.plans import planner, sync
from playlake.schema import PLAY, album_artist_of, id_uts, valid_id
from playlake.shipping import ship
from playlake.sources import pages
from playlake.sources.commits import OUTCOMES, PlayLog
from playlake.sources.plays import observations, read_log, write_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW, LO, HI, HOLE = 1_706_000_000, 1_704_500_000, 1_705_500_000, 1_705_000_000

# --- the tables that the queries share, in Spark and in SQL -----------------------------------------------------------

_OBS = f"""
obs0 AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, (floor(epoch(date_trunc('second', ts)) / 3600) * 3600)::BIGINT AS uts FROM events),
obs1 AS (SELECT event_id AS seq, uts, 'artist_' || (user_id % 20)::VARCHAR AS artist, 'track_' || (k % 10)::VARCHAR AS track,
    CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE 'album_' || (k % 5)::VARCHAR END AS album,
    (1704067200 + (event_id * 7919) % 7)::BIGINT AS fetched_at, event_type = 'error' AS deleted, event_type, user_id, value FROM obs0),
obs AS (SELECT *, uts::VARCHAR || '-' || substr(sha256(artist || chr(0) || track), 1, 8) AS id, strftime(make_timestamp(uts * 1000000), '%Y-%m') AS month FROM obs1),
cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, seq DESC) AS rn FROM obs) WHERE rn = 1),
live AS (SELECT * FROM cur WHERE NOT deleted),
cov0 AS (SELECT DISTINCT artist, uts AS start, uts + 5400 AS "end", min(fetched_at) OVER (PARTITION BY artist, uts) AS verified_at FROM obs),
cov1 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY artist ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM cov0),
cov2 AS (SELECT *, sum(brk) OVER (PARTITION BY artist ORDER BY start, "end") AS isl FROM cov1),
cov AS (SELECT artist, min(start) AS start, max("end") AS "end", min(verified_at) AS verified_at FROM cov2 GROUP BY artist, isl),
subj AS (SELECT artist, track, album, count(*) AS n, max(uts) AS latest_uts FROM live GROUP BY ALL)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _obs(spark, sf_dir) -> DataFrame:
    return observations(_table(spark, sf_dir, "events"))


def _live(spark, sf_dir, start=None, end=None) -> DataFrame:
    return store.live(_obs(spark, sf_dir), start, end)


def _raw_coverage(spark, sf_dir) -> DataFrame:
    """An hour and a half from each observation on, by artist."""
    rows = _obs(spark, sf_dir).groupBy("artist", F.col("uts").alias("start")).agg(F.min("fetched_at").alias("verified_at"))
    return rows.select("artist", "start", (F.col("start") + 5400).alias("end"), "verified_at")


def _coverage(spark, sf_dir) -> DataFrame:
    return interval.normalise(_raw_coverage(spark, sf_dir), ["artist"])


def _week(spark, artists: int = 20) -> DataFrame:
    """The range [LO, HOLE) for every artist."""
    return spark.range(artists).select(F.concat(F.lit("artist_"), F.col("id").cast("string")).alias("artist"), F.lit(LO).cast("long").alias("start"), F.lit(HOLE).cast("long").alias("end"), F.lit(0).cast("long").alias("verified_at"))


_WEEK = f"""wk AS (SELECT 'artist_' || range::VARCHAR AS artist, {LO}::BIGINT AS start, {HOLE}::BIGINT AS "end" FROM range(20))"""


def _sweep_sql(left: str, right: str, inside: str) -> str:
    """CTEs ending in ``swept`` (artist, start, end)."""
    return f"""
e AS (SELECT artist, start AS t, 1 AS da, 0 AS db FROM {left} UNION ALL SELECT artist, "end", -1, 0 FROM {left}
      UNION ALL SELECT artist, start, 0, 1 FROM {right} UNION ALL SELECT artist, "end", 0, -1 FROM {right}),
p AS (SELECT artist, t, sum(da) AS da, sum(db) AS db FROM e GROUP BY artist, t),
r AS (SELECT artist, t, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(t) OVER (PARTITION BY artist ORDER BY t) AS n FROM p WINDOW w AS (PARTITION BY artist ORDER BY t)),
q AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY artist ORDER BY t) = t THEN 0 ELSE 1 END AS brk FROM r WHERE {inside} AND n IS NOT NULL),
g AS (SELECT *, sum(brk) OVER (PARTITION BY artist ORDER BY t) AS isl FROM q),
swept AS (SELECT artist, min(t) AS start, max(n) AS "end" FROM g GROUP BY artist, isl)"""


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _on_obs(name, run, select, *more) -> None:
    register(name, run, "WITH " + ",\n".join([_OBS.strip(), *more]) + "\n" + select)


# --- store ------------------------------------------------------------------------------------------------------------

_PLAIN = ("id", "uts", "artist", "track", "album", "fetched_at", "deleted", "seq")
_COLS = ", ".join(_PLAIN)
_on_obs("lww_current", lambda s, d: store.current(_obs(s, d)).select(*_PLAIN), f"SELECT {_COLS} FROM cur")
_on_obs("lww_tombstones", lambda s, d: store.current(_obs(s, d)).filter("deleted").groupBy("artist").agg(F.count(F.lit(1)).alias("n")), "SELECT artist, count(*) AS n FROM cur WHERE deleted GROUP BY artist")
_on_obs("range_scan", lambda s, d: store.range_scan(_obs(s, d), LO, HI).select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE uts >= {LO} AND uts < {HI}")
_on_obs(
    "point_lookup",
    lambda s, d: store.current(_obs(s, d)).groupBy("artist").agg(F.min("id").alias("id")).join(store.current(_obs(s, d)).select("id", "uts", "deleted"), "id"),
    "SELECT artist, id, uts, deleted FROM (SELECT artist, min(id) AS id FROM cur GROUP BY artist) JOIN (SELECT id, uts, deleted FROM cur) USING (id)",
)
_on_obs("latest_uts", lambda s, d: store.latest_uts(_obs(s, d)), "SELECT max(uts) AS latest_uts FROM live")
_on_obs("play_id_hash", lambda s, d: _obs(s, d).select("seq", "id", id_uts("id").alias("id_uts"), valid_id("id").alias("valid")), "SELECT seq, id, split_part(id, '-', 1)::BIGINT AS id_uts, true AS valid FROM obs")
_on_obs("partition_bounds", lambda s, d: _obs(s, d).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("uts").alias("first_uts"), F.max("uts").alias("last_uts")), "SELECT month, count(*) AS n, min(uts) AS first_uts, max(uts) AS last_uts FROM obs GROUP BY month")


def _append(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    return store.append_stats(obs.filter("seq % 3 > 0"), obs.filter("seq % 3 = 0"))


_OUTCOMES = (
    """SELECT count(*) FILTER (WHERE o = 'new') AS n_new, count(*) FILTER (WHERE o = 'updated') AS n_updated, count(*) FILTER (WHERE o = 'unchanged') AS n_unchanged FROM o""",
    "held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, seq DESC) AS rn FROM obs WHERE seq % 3 > 0) WHERE rn = 1)",
    """b AS (SELECT x.*, (SELECT max({'f': y.fetched_at, 's': y.seq}) FROM obs y WHERE y.seq % 3 = 0 AND y.id = x.id AND y.seq < x.seq) AS prev FROM obs x WHERE x.seq % 3 = 0)""",
    """c AS (SELECT b.*, h.fetched_at AS hf, h.seq AS hs, CASE WHEN prev IS NOT NULL AND (h.fetched_at IS NULL OR prev.f >= h.fetched_at) THEN prev.s ELSE h.seq END AS ks FROM b LEFT JOIN held h USING (id))""",
    """o AS (SELECT CASE WHEN ks IS NULL THEN 'new' WHEN c.fetched_at < k.fetched_at OR (c.fetched_at = k.fetched_at AND c.album IS NOT DISTINCT FROM k.album AND c.deleted = k.deleted) THEN 'unchanged' ELSE 'updated' END AS o
          FROM c LEFT JOIN obs k ON k.seq = ks)""",
)
_on_obs("append_stats", _append, *_OUTCOMES)
def _rows(spark, sf_dir) -> DataFrame:
    """All observations with the log's whole schema."""
    return _obs(spark, sf_dir).withColumns({"source": F.lit("api"), "v": F.lit(1), "album_artist": album_artist_of(F.lit("api"), F.lit(None).cast("string"))})


def _log_append(spark, sf_dir) -> DataFrame:
    """Two thirds of the observations, then the others, as commits of a log; what the second one counted."""
    rows, log = _rows(spark, sf_dir), PlayLog(spark, new_folder(spark, "log"))
    log.append(rows.filter("seq % 3 > 0"))
    stats = log.append(rows.filter("seq % 3 = 0"))
    return spark.createDataFrame([tuple(stats[o] for o in OUTCOMES)], ", ".join(f"n_{o} long" for o in OUTCOMES))


def _log_compaction(spark, sf_dir) -> DataFrame:
    log = PlayLog(spark, new_folder(spark, "log"))
    log.append(_rows(spark, sf_dir))
    told = log.compact()
    left = log.read().groupBy("month").agg(F.count(F.lit(1)).alias("n_left"), F.count_if("deleted").alias("gone"))
    return told.join(left, "month")


def _log_unknown(spark, sf_dir) -> DataFrame:
    """The events' own properties as fields that a log's schema doesn't have: written, read, folded, written and read again."""
    props = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.from_json("props", "map<string,variant>").alias("unknown"))
    folder = new_folder(spark, "log")
    write_log(_rows(spark, sf_dir).select(*PLAY.names).join(props, "seq"), folder)
    held = store.current(read_log(spark, folder, unknown=True))
    folder = new_folder(spark, "log")
    write_log(held, folder)
    return read_log(spark, folder, unknown=True).select("id", "seq", F.variant_get(F.col("unknown")["k"], "$", "int").alias("k"), F.size("unknown").cast("long").alias("n_unknown"))


_on_obs("log_unknown", _log_unknown, "SELECT id, seq, (props->>'$.k')::INT AS k, len(json_keys(props))::BIGINT AS n_unknown FROM cur JOIN events ON event_id = seq")
_on_obs("log_append", _log_append, *_OUTCOMES)
_on_obs(
    "log_compaction", _log_compaction,
    "SELECT month, count(*) AS n_rows, count(DISTINCT id) AS kept, count(*) - count(DISTINCT id) AS dropped, count(*) > count(DISTINCT id) AS rewritten, count(*) FILTER (WHERE last) AS n_left, count(*) FILTER (WHERE last AND deleted) AS gone FROM ww GROUP BY month",
    "pv AS (SELECT x.*, (SELECT max({'f': y.fetched_at, 's': y.seq}) FROM obs y WHERE y.id = x.id AND y.seq < x.seq) AS prev FROM obs x)",
    """ww AS (SELECT pv.*, row_number() OVER (PARTITION BY pv.id ORDER BY pv.fetched_at DESC, pv.seq DESC) = 1 AS last FROM pv LEFT JOIN obs k ON k.seq = prev.s
          WHERE prev IS NULL OR NOT (pv.fetched_at < k.fetched_at OR (pv.fetched_at = k.fetched_at AND pv.album IS NOT DISTINCT FROM k.album AND pv.deleted = k.deleted)))""",
)
_on_obs("compact_counts", lambda s, d: store.compact_counts(_obs(s, d)), "SELECT month, count(*) AS n_rows, count(DISTINCT id) AS kept, count(*) - count(DISTINCT id) AS dropped FROM obs GROUP BY month")
_on_obs(
    "union_merge",
    lambda s, d: store.current(store.union_merge(_obs(s, d).filter("seq % 2 = 0"), _obs(s, d).filter("seq % 3 > 0"))).groupBy("artist").agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("gone"), F.sum("fetched_at").alias("fetched")),
    "SELECT artist, count(*) AS n, count(*) FILTER (WHERE deleted) AS gone, sum(fetched_at)::BIGINT AS fetched FROM m WHERE rn = 1 GROUP BY artist",
    "m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, seq DESC) AS rn FROM obs WHERE seq % 2 = 0 OR seq % 3 > 0)",
)
_on_obs(
    "provenance",
    lambda s, d: _obs(s, d).select("seq", album_artist_of(F.when(F.col("event_type") == "purchase", "scrape").otherwise("api"), F.col("album")).alias("p")).select("seq", "p.state", "p.value"),
    "SELECT seq, CASE WHEN album IS NULL THEN 'unknown' WHEN event_type = 'purchase' THEN 'verified' ELSE 'unverified' END AS state, album AS value FROM obs",
)


def _mirror(spark, sf_dir):
    plays = _live(spark, sf_dir)
    edits = plays.filter(F.col("track") == "track_3").select("id", F.col("artist").alias("new_artist"), F.lit("track_3b").alias("new_track"), F.col("album").alias("new_album"), F.col("artist").alias("new_album_artist"))
    return store.mirror_edit(plays, edits, NOW).select("id", "uts", "artist", "track", "album", "deleted", "fetched_at")


_on_obs(
    "mirror_edit", _mirror,
    f"""SELECT id, uts, artist, track, album, true AS deleted, {NOW}::BIGINT AS fetched_at FROM t
        UNION ALL SELECT uts::VARCHAR || '-' || substr(sha256(artist || chr(0) || 'track_3b'), 1, 8), uts, artist, 'track_3b', album, false, {NOW}::BIGINT FROM t""",
    "t AS (SELECT * FROM live WHERE track = 'track_3')",
)

# --- queries ----------------------------------------------------------------------------------------------------------

_on_obs("top_artists", lambda s, d: query.top_artists(_live(s, d), 10), "SELECT artist, count(*) AS n FROM live GROUP BY artist ORDER BY n DESC, artist LIMIT 10")
_on_obs("top_artists_range", lambda s, d: query.top_artists(_live(s, d, LO, HI), 10), f"SELECT artist, count(*) AS n FROM live WHERE uts >= {LO} AND uts < {HI} GROUP BY artist ORDER BY n DESC, artist LIMIT 10")
_on_obs("top_tracks", lambda s, d: query.top_tracks(_live(s, d), 25), "SELECT artist, track, count(*) AS n FROM live GROUP BY ALL ORDER BY n DESC, artist, track LIMIT 25")
_on_obs("top_tracks_by_artist", lambda s, d: query.top_tracks(_live(s, d), 5, "artist_3"), "SELECT artist, track, count(*) AS n FROM live WHERE artist = 'artist_3' GROUP BY ALL ORDER BY n DESC, artist, track LIMIT 5")
_on_obs("top_albums", lambda s, d: query.top_albums(_live(s, d), 25), "SELECT artist, album, count(*) AS n FROM live WHERE album <> '' GROUP BY ALL ORDER BY n DESC, artist, album LIMIT 25")
_on_obs("play_count", lambda s, d: query.play_count(_live(s, d)), "SELECT count(*) AS n FROM live")
_on_obs("play_count_range", lambda s, d: query.play_count(_live(s, d, LO, HI)), f"SELECT count(*) AS n FROM live WHERE uts >= {LO} AND uts < {HI}")
_on_obs("artist_plays", lambda s, d: query.artist_plays(_live(s, d), "artist_3").select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE artist = 'artist_3'")
_on_obs("recent_first_page", lambda s, d: query.recent(_live(s, d), 50).select(*_PLAIN), f"SELECT {_COLS} FROM live ORDER BY uts DESC, id DESC LIMIT 50")
_CURSOR = (HI, f"{HI}-80000000")
_AFTER = f"(uts < {_CURSOR[0]} OR (uts = {_CURSOR[0]} AND id < '{_CURSOR[1]}'))"
_on_obs("recent_keyset_page", lambda s, d: query.recent(_live(s, d), 50, _CURSOR).select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE {_AFTER} ORDER BY uts DESC, id DESC LIMIT 50")
_FOUND = "contains(lower(artist) || chr(1) || lower(track) || chr(1) || lower(coalesce(album, '')), 'artist_1') AND contains(lower(artist) || chr(1) || lower(track) || chr(1) || lower(coalesce(album, '')), 'k_7')"
_on_obs("search_recent", lambda s, d: query.search_recent(_live(s, d), "ARTIST_1 k_7", 50).select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE {_FOUND} ORDER BY uts DESC, id DESC LIMIT 50")
_GROUPS = f"SELECT artist, track, album, count(*) AS n, min(uts) AS first_uts, max(uts) AS latest_uts FROM live WHERE {_FOUND} GROUP BY ALL ORDER BY latest_uts DESC, artist, track, album NULLS FIRST LIMIT 15"
_on_obs("search_groups", lambda s, d: query.search_groups(_live(s, d), "artist_1 k_7", 15), _GROUPS)
_on_obs("search_groups_page2", lambda s, d: query.search_groups(_live(s, d), "artist_1 k_7", 15, 15), _GROUPS + " OFFSET 15")
_on_obs(
    "store_status", lambda s, d: query.store_status(_live(s, d), _coverage(s, d), NOW),
    f"""SELECT n, oldest, newest, segments, covered, frontier, {NOW} - frontier AS stale_seconds FROM (SELECT count(*) AS n, min(uts) AS oldest, max(uts) AS newest FROM live),
        (SELECT count(*) AS segments, sum("end" - start)::BIGINT AS covered, max("end") AS frontier FROM cov)""",
)
_on_obs(
    "library_30d", lambda s, d: query.library(query.rolling(_live(s, d), NOW, 30), 25),
    """SELECT 'total' AS kind, NULL AS artist, NULL AS name, count(*) AS n FROM w UNION ALL SELECT 'latest', NULL, NULL, max(uts) FROM w
       UNION ALL (SELECT 'artist', artist, NULL, count(*) AS n FROM w GROUP BY artist ORDER BY n DESC, artist LIMIT 25)
       UNION ALL (SELECT 'album', artist, album, count(*) AS n FROM w WHERE album <> '' GROUP BY artist, album ORDER BY n DESC, artist, album LIMIT 25)""",
    f"w AS (SELECT * FROM live WHERE uts >= {NOW} - 30 * 86400 AND uts < {NOW})",
)
_on_obs(
    "album_sections", lambda s, d: query.album_sections(_live(s, d)),
    """SELECT artist, album, track, n, dense_rank() OVER (PARTITION BY artist ORDER BY album) AS album_no, row_number() OVER (PARTITION BY artist, album ORDER BY n DESC, track) AS track_no
       FROM (SELECT artist, album, track, count(*) AS n FROM live WHERE album <> '' GROUP BY ALL)""",
)
_on_obs("offset_range", lambda s, d: query.offset_range(_live(s, d), 10, 30).select(*_PLAIN), f"SELECT {_COLS} FROM live ORDER BY uts DESC, id DESC LIMIT 21 OFFSET 10")
_on_obs("between_times", lambda s, d: query.between_times(_live(s, d), LO - LO % 3600, HI - HI % 3600).select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE uts BETWEEN {LO - LO % 3600} AND {HI - HI % 3600}")
_on_obs("first_match", lambda s, d: query.first_match(_live(s, d), "artist_3", "track_4").select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE artist = 'artist_3' AND track = 'track_4' ORDER BY uts DESC, id DESC LIMIT 1")

# --- intervals --------------------------------------------------------------------------------------------------------

_A = ["artist"]
_on_obs("coverage_normalise", lambda s, d: _coverage(s, d), 'SELECT artist, start, "end", verified_at FROM cov')
_on_obs("coverage_total", lambda s, d: interval.total(_coverage(s, d), _A), 'SELECT artist, sum("end" - start)::BIGINT AS covered, min(start) AS first_start, max("end") AS last_end, count(*) AS segments FROM cov GROUP BY artist')
_on_obs("coverage_union", lambda s, d: interval.union(_coverage(s, d), _week(s), _A).drop("verified_at"), 'SELECT artist, start, "end" FROM swept', _WEEK, _sweep_sql("cov", "wk", "(a > 0 OR b > 0)").strip())
_on_obs("coverage_intersect", lambda s, d: interval.intersect(_coverage(s, d), _week(s), _A), 'SELECT artist, start, "end" FROM swept', _WEEK, _sweep_sql("cov", "wk", "a > 0 AND b > 0").strip())
_on_obs("coverage_subtract", lambda s, d: interval.subtract(_coverage(s, d), _week(s), _A), 'SELECT s.artist, s.start, s."end", c.verified_at FROM swept s JOIN cov c ON c.artist = s.artist AND c.start <= s.start AND c."end" >= s."end"', _WEEK, _sweep_sql("cov", "wk", "a > 0 AND b = 0").strip())
_on_obs("coverage_gaps", lambda s, d: interval.gaps(_coverage(s, d), LO, HOLE, _A), 'SELECT artist, start, "end" FROM swept', _WEEK, "held AS (SELECT * FROM wk WHERE artist IN (SELECT artist FROM cov))", _sweep_sql("held", "cov", "a > 0 AND b = 0").strip())
_on_obs("coverage_covers", lambda s, d: interval.covers(_coverage(s, d), LO, LO + 3600, _A), f'SELECT artist, bool_or(start <= {LO} AND "end" >= {LO + 3600}) AS covered FROM cov GROUP BY artist')
_on_obs(
    "coverage_insert_changes", lambda s, d: interval.insert_changes(_coverage(s, d), _week(s), _A),
    f"""SELECT w.artist, CASE count(c.start) WHEN 0 THEN 'created' WHEN 1 THEN 'extended' ELSE 'merged' END AS kind, least(min(c.start), {LO})::BIGINT AS start, greatest(max(c."end"), {HOLE})::BIGINT AS "end", count(c.start) AS absorbed
        FROM wk w LEFT JOIN cov c ON c.artist = w.artist AND c.start <= w."end" AND c."end" >= w.start GROUP BY w.artist""",
    _WEEK,
)
_on_obs(
    "coverage_subtract_changes", lambda s, d: interval.subtract_changes(_coverage(s, d), _week(s), _A),
    f"""SELECT artist, CASE pieces WHEN 0 THEN 'removed' WHEN 2 THEN 'split' ELSE 'shrunk' END AS kind, start, "end", pieces
        FROM (SELECT *, (start < {LO})::BIGINT + ("end" > {HOLE})::BIGINT AS pieces FROM cov WHERE start < {HOLE} AND "end" > {LO})""",
)
_on_obs(
    "range_join_counts",
    lambda s, d: interval.contains(_live(s, d), interval.subtract(_coverage(s, d), _week(s), _A).withColumn("verified_at", F.lit(0).cast("long")), _A).groupBy("artist").agg(F.count(F.lit(1)).alias("n")),
    'SELECT l.artist, count(*) AS n FROM live l JOIN swept s ON l.artist = s.artist AND l.uts >= s.start AND l.uts < s."end" GROUP BY l.artist', _WEEK, _sweep_sql("cov", "wk", "a > 0 AND b = 0").strip(),
)


def _incremental(spark, sf_dir):
    """Each artist a provider that has looked at its own coverage, over what all of them have."""
    coverage = _coverage(spark, sf_dir)
    synced = interval.normalise(coverage.select("start", "end", "verified_at"))
    return interval.incremental_work(synced, coverage, LO - 10_000, HI + 10_000, "artist")


_on_obs(
    "incremental_work", _incremental,
    """SELECT min(t) AS start, max(n) AS "end" FROM (SELECT *, sum(brk) OVER (ORDER BY t, n) AS g FROM (SELECT start AS t, "end" AS n, CASE WHEN start <= max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM swept)) GROUP BY g""",
    """sy1 AS (SELECT *, CASE WHEN start <= max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM cov)""",
    """sy2 AS (SELECT min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(brk) OVER (ORDER BY start, "end") AS g FROM sy1) GROUP BY g)""",
    f"""win AS (SELECT artist, greatest(start, {LO - 10_000})::BIGINT AS start, least("end", {HI + 10_000})::BIGINT AS "end" FROM sy2, (SELECT DISTINCT artist FROM cov) WHERE greatest(start, {LO - 10_000}) < least("end", {HI + 10_000}))""",
    _sweep_sql("win", "cov", "a > 0 AND b = 0").strip(),
)

# --- subjects and reconciliation --------------------------------------------------------------------------------------

_on_obs("subjects", lambda s, d: subjects.group_by_subject(_live(s, d)), "SELECT artist, track, album, NULL::VARCHAR AS album_artist, n, latest_uts FROM subj")


def _dismissed(spark, sf_dir):
    return subjects.group_by_subject(_live(spark, sf_dir)).filter(F.col("latest_uts") % 7200 == 0).select(*subjects.KEY)


_on_obs(
    "subjects_undismissed", lambda s, d: subjects.without(subjects.group_by_subject(_live(s, d)), _dismissed(s, d)).drop("album_artist"),
    "SELECT artist, track, album, n, latest_uts FROM subj WHERE latest_uts % 7200 <> 0",
)
_on_obs(
    "subject_expand",
    lambda s, d: subjects.expand(_dismissed(s, d), _live(s, d).withColumn("album_artist", F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("value")))).select("id", "artist", "track", "album"),
    "SELECT l.id, l.artist, l.track, l.album FROM live l JOIN subj s ON l.artist = s.artist AND l.track = s.track AND l.album IS NOT DISTINCT FROM s.album WHERE s.latest_uts % 7200 = 0",
)
_on_obs(
    "verify_tombstones", lambda s, d: reconcile.verify(_obs(s, d), _obs(s, d).filter("seq % 5 > 0"), LO, HI, NOW).select("id", "deleted", "fetched_at"),
    f"SELECT id, true AS deleted, {NOW}::BIGINT AS fetched_at FROM live WHERE uts >= {LO} AND uts < {HI} AND id NOT IN (SELECT id FROM obs WHERE seq % 5 > 0)",
)


def _listed(spark, sf_dir):
    return _obs(spark, sf_dir).filter("seq % 11 = 0").groupBy("id").agg(F.min("seq").alias("place"))


_on_obs("ids_semi_join", lambda s, d: store.ids_in_order(_obs(s, d), _listed(s, d)).select("id", "place", "artist"), "SELECT id, place, artist FROM live JOIN (SELECT id, min(seq) AS place FROM obs WHERE seq % 11 = 0 GROUP BY id) USING (id)")


def _variations(spark, sf_dir):
    rows = _obs(spark, sf_dir).filter("album is not null and album <> ''").groupBy("artist", "track", F.col("album").alias("v_album")).agg(F.min("seq").alias("pos"))
    return rows.filter(F.col("pos") % 2 == 0).withColumn("v_album_artist", F.concat(F.col("artist"), F.lit(" of "), F.col("v_album")))


_on_obs(
    "enrich_fallback", lambda s, d: reconcile.enrich(_live(s, d), _variations(s, d)),
    """SELECT id, artist, track, CASE WHEN v_album IS NOT NULL THEN coalesce(album, v_album) ELSE album END AS album, artist || ' of ' || v_album AS album_artist, CASE WHEN v_album IS NULL THEN 'api' ELSE 'scrape' END AS source
       FROM (SELECT l.*, v.v_album, row_number() OVER (PARTITION BY l.id ORDER BY coalesce(l.album = v.v_album, false) DESC, pos NULLS LAST) AS rn FROM live l LEFT JOIN v USING (artist, track)) WHERE rn = 1""",
    "v AS (SELECT artist, track, album AS v_album, min(seq) AS pos FROM obs WHERE album <> '' GROUP BY ALL HAVING min(seq) % 2 = 0)",
)


def _applied(spark, sf_dir):
    live = _live(spark, sf_dir)
    edits = live.select(F.col("id").alias("edit_id"), "uts", F.col("artist").alias("old_artist"), F.lit("track_1").alias("old_track"), F.col("album").alias("old_album"), F.col("artist").alias("new_artist"), F.col("track").alias("new_track"), F.col("album").alias("new_album"))
    return reconcile.already_applied(edits, live)


_on_obs(
    "already_applied", _applied,
    """SELECT e.id AS edit_id, true AS new_there, o.x AS old_there, NOT o.x AS applied
       FROM live e, LATERAL (SELECT coalesce(bool_or(u.artist = e.artist AND u.track = 'track_1' AND u.album IS NOT DISTINCT FROM e.album), false) AS x FROM live u WHERE u.uts = e.uts) o""",
)


def _partial_edits(spark, sf_dir):
    """Each user's first observation as an edit: of two users in three the track is given, of two in four the album, which some of them never had."""
    first = _obs(spark, sf_dir).groupBy(F.col("user_id").alias("u")).agg(F.min_by(F.struct("artist", "track", "album"), "seq").alias("f"))
    return first.select(
        F.col("u").alias("edit_id"), "f.artist", F.when(F.col("u") % 3 > 0, F.col("f.track")).alias("track"), F.when(F.col("u") % 4 == 0, F.coalesce("f.album", F.lit("nowhere"))).when(F.col("u") % 4 == 1, "nowhere").alias("album"),
        F.when(F.col("u") % 5 == 0, "Renamed").alias("new_artist"), F.when(F.col("u") % 5 == 1, "Retitled").alias("new_track"), F.when(F.col("u") % 5 == 2, "Reissue").alias("new_album"),
    )


_on_obs(
    "discover_edits", lambda s, d: reconcile.discover(_partial_edits(s, d), _live(s, d).withColumn("album_artist", F.col("artist"))).drop("original_album_artist"),
    """SELECT e.edit_id, e.artist AS original_artist, l.track AS original_track, l.album AS original_album, CASE WHEN l.artist IS NOT NULL THEN coalesce(na, l.artist) END AS new_artist, CASE WHEN l.artist IS NOT NULL THEN coalesce(nt, l.track) END AS new_track,
              CASE WHEN l.artist IS NOT NULL THEN coalesce(nb, l.album) END AS new_album, l.artist AS new_album_artist, CASE WHEN l.artist IS NULL THEN 'no such play' END AS error
       FROM ed e LEFT JOIN (SELECT DISTINCT artist, track, album FROM live) l ON l.artist = e.artist AND (e.track IS NULL OR e.track = l.track) AND (e.album IS NULL OR e.album = l.album) WHERE l.artist IS NOT NULL OR (e.track IS NOT NULL AND e.album IS NOT NULL)""",
    "uf AS (SELECT user_id AS u, arg_min({'artist': artist, 'track': track, 'album': album}, seq) AS f FROM obs GROUP BY user_id)",
    """ed AS (SELECT u AS edit_id, f.artist AS artist, CASE WHEN u % 3 > 0 THEN f.track END AS track, CASE u % 4 WHEN 0 THEN coalesce(f.album, 'nowhere') WHEN 1 THEN 'nowhere' END AS album,
           CASE WHEN u % 5 = 0 THEN 'Renamed' END AS na, CASE WHEN u % 5 = 1 THEN 'Retitled' END AS nt, CASE WHEN u % 5 = 2 THEN 'Reissue' END AS nb FROM uf)""",
)
_on_obs(
    "response_summary", lambda s, d: reconcile.response_summary(_obs(s, d).select(F.col("user_id").alias("edit_id"), F.when(F.col("event_type") != "view", F.col("event_type") != "error").alias("success"))),
    """SELECT edit_id, n, ok, n > 0 AND ok = n AS all_successful, ok > 0 AS any_successful, CASE WHEN n = 0 THEN 'nothing to do' ELSE ok::VARCHAR || ' of ' || n::VARCHAR || ' succeeded' END AS message
       FROM (SELECT user_id AS edit_id, count(*) FILTER (WHERE event_type <> 'view') AS n, count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) AS ok FROM obs GROUP BY user_id)""",
)
_on_obs(
    "delete_manifest", lambda s, d: reconcile.bulk_delete(_live(s, d, LO, HI), _obs(s, d).filter("seq % 3 = 0").groupBy("id").agg(F.max(F.col("seq") % 2 == 0).alias("success"))),
    f"""SELECT l.id, uts, row_number() OVER (ORDER BY uts DESC, l.id DESC) AS number, CASE WHEN s IS NULL THEN 'pending' WHEN s THEN 'deleted' ELSE 'failed' END AS status
        FROM live l LEFT JOIN (SELECT id, bool_or(seq % 2 = 0) AS s FROM obs WHERE seq % 3 = 0 GROUP BY id) r ON l.id = r.id WHERE uts >= {LO} AND uts < {HI}""",
)


def _suggested(spark, sf_dir):
    rows = _live(spark, sf_dir)
    return rows.select("artist", "track", "album", F.lit(None).cast("string").alias("album_artist"), (F.col("seq") % 3).alias("provider_rank"), F.col("seq").alias("idx"), F.when(F.col("seq") % 4 == 0, "none").otherwise("edit").alias("kind"), F.col("id").alias("payload"))


_on_obs(
    "first_suggestion_wins", lambda s, d: subjects.first_suggestions(_suggested(s, d)).select("artist", "track", "album", "provider_rank", "payload"),
    "SELECT artist, track, album, seq % 3 AS provider_rank, id AS payload FROM (SELECT *, row_number() OVER (PARTITION BY artist, track, album ORDER BY seq % 3, seq) AS rn FROM live WHERE seq % 4 <> 0) WHERE rn = 1",
)
_on_obs(
    "combined_suggestions", lambda s, d: subjects.combined(_suggested(s, d)).select("artist", "track", "album", F.array_join(F.transform("suggestions", lambda x: x["payload"]), ",").alias("payloads")),
    "SELECT artist, track, album, string_agg(id, ',' ORDER BY seq % 3, seq) AS payloads FROM live GROUP BY ALL",
)

# --- rules ------------------------------------------------------------------------------------------------------------

_PARTS = [rules.Rule(r"^(\w+) red$", "$1", "i"), rules.Rule(r"blue", "azure"), rules.Rule(r"^(?P<a>\w+) (?P<b>\w+)$", "${b}, ${a}"), rules.Rule(r"(\d{4}) Remaster", "$1 Version"), rules.Rule(r"feat\.", "featuring")]


def _titles(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" - "), (F.lit(1980) + F.col("p_size")).cast("string"), F.lit(" Remaster"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit(" ("), (F.lit(1990) + F.col("p_size") % 20).cast("string"), F.lit(")"))).when(F.col("p_size") % 5 == 2, " [Remastered]").otherwise("")
    return p.select("p_partkey", "p_name", F.concat("p_name", end).alias("title"), "p_size")


_TITLES = """t AS (SELECT p_partkey, p_name, p_size, p_name || CASE p_size % 5 WHEN 0 THEN ' - ' || (1980 + p_size)::VARCHAR || ' Remaster' WHEN 1 THEN ' (' || (1990 + p_size % 20)::VARCHAR || ')' WHEN 2 THEN ' [Remastered]' ELSE '' END AS title FROM part)"""
register(
    "rule_rewrite_whole",
    lambda s, d: _titles(s, d).select("p_partkey", rules.Rule(r"(\d{4}) Remaster", "$1 Version").apply(F.col("title")).alias("by_year"), rules.Rule(r"^b", "starts with b").apply(F.col("title")).alias("by_start"), rules.Rule("REMASTERED", "R", "i").apply(F.col("title")).alias("by_case")),
    f"""WITH {_TITLES} SELECT p_partkey, CASE WHEN regexp_matches(title, '(\\d{{4}}) Remaster') THEN regexp_extract(title, '(\\d{{4}}) Remaster', 1) || ' Version' ELSE title END AS by_year,
        CASE WHEN title LIKE 'b%' THEN 'starts with b' ELSE title END AS by_start, CASE WHEN regexp_matches(title, '(?i)REMASTERED') THEN 'R' ELSE title END AS by_case FROM t""",
)


def _rewrite_exact(spark, sf_dir):
    ship(spark)
    names = _table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", *[r.apply(F.col("p_name")).alias(f"r{k}") for k, r in enumerate(_PARTS)])


register(
    "rule_rewrite_exact", _rewrite_exact,
    r"""SELECT DISTINCT p_name, CASE WHEN regexp_matches(p_name, '(?i)^(\w+) red$') THEN regexp_extract(p_name, '(?i)^(\w+) red$', 1) ELSE p_name END AS r0, CASE WHEN contains(p_name, 'blue') THEN 'azure' ELSE p_name END AS r1,
        CASE WHEN regexp_matches(p_name, '^(\w+) (\w+)$') THEN regexp_replace(p_name, '^(\w+) (\w+)$', '\2, \1') ELSE p_name END AS r2, p_name AS r3, p_name AS r4 FROM part""",
)


def _edits(spark, sf_dir):
    return _live(spark, sf_dir).select("id", "artist", "track", F.nullif("album", F.lit("")).alias("album"), F.lit(None).cast("string").alias("album_artist"))


_ANY = rules.RewriteRule({"track": rules.Rule(r"_[1-4]$", "x"), "album": rules.Rule(".*", "y")})
_SET = rules.RewriteRule({"track": rules.Rule(r"_[1-4]$", "x"), "album": rules.Rule(".+", "y")})
_on_obs(
    "rule_match_none", lambda s, d: _edits(s, d).select("id", _ANY.matches_edit().alias("any_album"), _SET.matches_edit().alias("some_album"), _ANY.matches_track().alias("as_track")),
    "SELECT id, regexp_matches(track, '_[1-4]$') AS any_album, regexp_matches(track, '_[1-4]$') AND coalesce(album, '') <> '' AS some_album, regexp_matches(track, '_[1-4]$') AS as_track FROM live",
)
_CHAIN = [
    rules.RewriteRule({"track": rules.Rule(r"^track_([0-4])$", "Track $1")}, "spell"),
    rules.RewriteRule({"track": rules.Rule(r"^Track 3$", "Third"), "artist": rules.Rule("artist_1[0-9]", "Various")}, "third", requires_confirmation=True),
    rules.RewriteRule({"album": rules.Rule(r"album_(\d)", "Album $1")}, "album"),
]


def _planned(spark, sf_dir):
    ship(spark)
    return planner.plan(_live(spark, sf_dir), _CHAIN, _dismissed(spark, sf_dir), _dismissed(spark, sf_dir).limit(0))


_CHAINED = """ch AS (SELECT *, CASE WHEN regexp_matches(track, '^track_[0-4]$') THEN 'Track ' || track[-1] ELSE track END AS t1 FROM subj WHERE latest_uts % 7200 <> 0),
c2 AS (SELECT *, t1 = 'Track 3' AND regexp_matches(artist, 'artist_1[0-9]') AS h FROM ch),
c3 AS (SELECT artist, track, album, n, latest_uts, CASE WHEN h THEN 'Third' ELSE t1 END AS new_track, CASE WHEN h THEN 'Various' ELSE artist END AS new_artist, CASE WHEN album LIKE 'album_%' THEN 'Album ' || album[-1] ELSE album END AS new_album, h AS confirm FROM c2)"""
_on_obs(
    "rule_chain", lambda s, d: _planned(s, d).select("artist", "track", "album", "n", "latest_uts", "new_track", "new_artist", "new_album", "confirm", "outcome"),
    """SELECT *, CASE WHEN confirm THEN 'awaiting_approval' ELSE 'ready' END AS outcome FROM c3 WHERE new_track <> track OR new_artist <> artist OR new_album IS DISTINCT FROM album""", _CHAINED,
)
_on_obs(
    "plan_report", lambda s, d: planner.report(_planned(s, d)),
    """SELECT CASE WHEN confirm THEN 'awaiting_approval' ELSE 'ready' END AS outcome, count(*) AS subjects, sum(n)::BIGINT AS plays FROM c3 WHERE new_track <> track OR new_artist <> artist OR new_album IS DISTINCT FROM album GROUP BY 1""", _CHAINED,
)
register(
    "suffix_cleanup", lambda s, d: _titles(s, d).select("p_partkey", rules.without_suffixes(F.col("title")).alias("clean")),
    f"WITH {_TITLES} SELECT p_partkey, p_name AS clean FROM t",
)
_on_obs(
    "edit_diff",
    lambda s, d: _live(s, d).select("id", subjects.diff_text({"track": (F.col("track"), F.when(F.col("track") == "track_3", "Third").otherwise(F.col("track"))), "album": (F.col("album"), F.when(F.col("album").isNull(), "None").otherwise(F.col("album")))}).alias("diff")),
    """SELECT id, CASE WHEN track <> 'track_3' AND album IS NOT NULL THEN 'no changes' ELSE concat_ws('; ', CASE WHEN track = 'track_3' THEN 'track: ' || track || ' -> Third' END, CASE WHEN album IS NULL THEN 'album:  -> None' END) END AS diff FROM live""",
)


def _overlaid(spark, sf_dir):
    rows = _live(spark, sf_dir).select("id", F.col("track").alias("original_track"), F.when(F.col("track") == "track_3", "Third").otherwise(F.col("track")).alias("new_track"), F.concat("track", F.lit("'")).alias("current_track"), F.col("album").alias("original_album"), F.lit(None).cast("string").alias("new_album"), F.col("album").alias("current_album"))
    return subjects.overlay(rows, ("track", "album")).select("id", "result_track", "result_album")


_on_obs("edit_overlay", _overlaid, "SELECT id, CASE WHEN track = 'track_3' THEN 'Third' ELSE track || '''' END AS result_track, album AS result_album FROM live")

# --- event logs -------------------------------------------------------------------------------------------------------

_EVENTS = {"signup": "created", "click": "approved", "purchase": "applied", "error": "failed", "view": "expanded"}


def _log(spark, sf_dir, names=None) -> DataFrame:
    """``events`` as a log of each user's intent."""
    names = names or _EVENTS
    event = F.lit(None).cast("string")
    for k, v in names.items():
        event = F.when(F.col("event_type") == k, v).otherwise(event)
    rows = _table(spark, sf_dir, "events")
    return rows.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), event.alias("event"),
        (F.col("event_id") % 2 == 0).alias("requires_approval"), (F.col("event_id") % 3 == 0).alias("dismiss"), (F.col("event_id") % 4).cast("string").alias("instance"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"),
    )


_QUEUE = {"signup": "created", "click": "approved", "purchase": "rejected", "error": "reinstated", "view": "expanded"}
_LOG = """lg AS (SELECT user_id AS id, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS "at", event_type AS e, event_id % 2 = 0 AS appr, event_id % 3 = 0 AS dis, (event_id % 4)::VARCHAR AS inst FROM events),
fc AS (SELECT id, min(seq) AS c FROM lg WHERE e = 'signup' GROUP BY id),
ok AS (SELECT lg.* FROM lg JOIN fc USING (id) WHERE seq = c OR (seq > c AND e <> 'signup'))"""
register(
    "fold_edit_log", lambda s, d: eventlog.fold_edit_log(_log(s, d, {"signup": "queued", "error": "failed", "purchase": "applied", "click": "failed", "view": "other"})),
    f"""WITH {_LOG}, tm AS (SELECT ok.*, (SELECT min(seq) FROM ok z WHERE z.id = ok.id AND z.e = 'purchase') AS fin FROM ok)
        SELECT id, CASE WHEN min(fin) IS NULL THEN 'pending' ELSE 'applied' END AS state, count(*) FILTER (WHERE e IN ('error', 'click') AND (fin IS NULL OR seq < fin)) AS attempts,
               arg_max('error ' || seq::VARCHAR, seq) FILTER (WHERE e IN ('error', 'click') AND (fin IS NULL OR seq < fin)) AS last_error, arg_min("at", seq) AS created_at, arg_max("at", seq) AS updated_at, min(seq) AS place FROM tm GROUP BY id""",
)
_STATE = f"""{_LOG},
rw AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM ok),
st AS (WITH RECURSIVE f AS (SELECT id, k, seq, "at" AS created_at, "at" AS updated_at, seq AS place, appr, CASE WHEN appr THEN 'awaiting_approval' ELSE 'ready' END AS state, false AS dismissed FROM rw WHERE k = 1
       UNION ALL SELECT f.id, r.k, r.seq, f.created_at, r."at", f.place, f.appr,
         CASE WHEN r.e = 'click' AND state = 'awaiting_approval' THEN 'ready' WHEN r.e = 'purchase' THEN 'rejected' WHEN r.e = 'error' AND state = 'rejected' THEN CASE WHEN f.appr THEN 'awaiting_approval' ELSE 'ready' END
              WHEN r.e = 'view' AND state = 'ready' THEN 'in_progress' ELSE state END,
         CASE WHEN r.e = 'purchase' THEN r.dis WHEN r.e = 'error' AND state = 'rejected' THEN false ELSE dismissed END
       FROM f JOIN rw r ON r.id = f.id AND r.k = f.k + 1) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS z FROM f) WHERE z = 1)"""
_ST = "WITH " + _STATE


def _intents(spark, sf_dir):
    return eventlog.fold_queue(_log(spark, sf_dir, _QUEUE))


register("fold_queue_state", _intents, f"{_ST} SELECT id, state, appr AS requires_approval, state = 'rejected' AND dismissed AS dismissed, created_at, updated_at, place FROM st")
register("execution_order", lambda s, d: eventlog.execution_order(_intents(s, d)).select("id", "state", "place"), f"{_ST} SELECT id, state, place FROM st WHERE state IN ('ready', 'in_progress')")
register("state_counts", lambda s, d: eventlog.state_counts(_intents(s, d)), f"{_ST} SELECT state, count(*) AS n FROM st GROUP BY state")
register(
    "review_status", lambda s, d: _intents(s, d).select("id", eventlog.review_status().alias("review"), eventlog.work_status().alias("work")),
    f"""{_ST} SELECT id, CASE WHEN state = 'awaiting_approval' THEN 'needs_review' WHEN state IN ('ready', 'in_progress') THEN 'approved' WHEN dismissed THEN 'dismissed' ELSE 'rejected' END AS review,
        CASE state WHEN 'awaiting_approval' THEN 'waiting' WHEN 'ready' THEN 'queued' WHEN 'in_progress' THEN 'running' ELSE 'off' END AS work FROM st""",
)


def _instances(spark, sf_dir):
    return eventlog.fold_instances(_log(spark, sf_dir))


_INST = """ins AS (SELECT user_id AS id, (event_id % 4)::VARCHAR AS instance, event_id AS seq, event_type AS e FROM events WHERE event_type IN ('view', 'purchase', 'error')),
li AS (SELECT *, max(seq) FILTER (WHERE e = 'purchase') OVER (PARTITION BY id, instance) AS ap, max(seq) FILTER (WHERE e <> 'view') OVER (PARTITION BY id, instance) AS la FROM ins),
inst AS (SELECT id, instance, CASE arg_max(e, seq) FILTER (WHERE e <> 'view') WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
         count(*) FILTER (WHERE e = 'error' AND seq > coalesce(ap, -1)) AS attempts, arg_max('error ' || seq::VARCHAR, seq) FILTER (WHERE e = 'error' AND seq > coalesce(ap, -1)) AS last_error FROM li GROUP BY id, instance)"""
register("fold_instances", _instances, f"WITH {_INST} SELECT * FROM inst")
register(
    "instance_progress", lambda s, d: eventlog.instance_progress(_instances(s, d)),
    f"WITH {_INST} SELECT id, count(*) FILTER (WHERE status = 'applied') AS n_applied, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'pending') AS n_pending FROM inst GROUP BY id",
)
register(
    "intent_completion", lambda s, d: eventlog.completion(_instances(s, d), s.range(3).select(F.col("id").cast("string")), 2),
    f"""WITH {_INST} SELECT id, CASE WHEN bool_and(status = 'applied' OR instance = '3') THEN 'completed' WHEN bool_and(status = 'applied' OR (status = 'failed' AND attempts >= 2) OR instance = '3') THEN 'abandoned' ELSE 'open' END AS outcome FROM inst GROUP BY id""",
)
register(
    "work_queue_totals", lambda s, d: eventlog.work_queue_totals(_intents(s, d), eventlog.instance_progress(_instances(s, d).filter("instance <> '1'"))),
    f"""{_ST}, {_INST} SELECT count(DISTINCT st.id) AS intents, count(DISTINCT st.id) FILTER (WHERE i.id IS NULL) AS unexpanded, count(*) FILTER (WHERE i.status = 'applied') AS n_applied, count(*) FILTER (WHERE i.status = 'failed') AS n_failed, count(*) FILTER (WHERE i.status = 'pending') AS n_pending
        FROM st LEFT JOIN (SELECT * FROM inst WHERE instance <> '1') i ON i.id = st.id WHERE st.state IN ('ready', 'in_progress')""",
)
register(
    "fold_rules", lambda s, d: eventlog.fold_rules(_log(s, d, {"signup": "proposed", "click": "approved", "error": "rejected", "view": "seen", "purchase": "seen"})),
    f"""WITH {_LOG} SELECT id, coalesce(CASE arg_max(e, seq) FILTER (WHERE e IN ('click', 'error')) WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected' END, 'pending') AS state, arg_min("at", seq) AS "at" FROM ok GROUP BY id""",
)
_on_obs(
    "dismissed_lww", lambda s, d: eventlog.fold_dismissed(_obs(s, d).select("artist", "track", "album", F.col("fetched_at").alias("at"), "seq", (F.col("event_type") != "error").alias("active")), ["artist", "track", "album"]),
    'SELECT artist, track, album, fetched_at AS "at", seq, true AS active FROM (SELECT *, row_number() OVER (PARTITION BY artist, track, album ORDER BY fetched_at DESC, seq DESC) AS rn FROM obs) WHERE rn = 1 AND event_type <> \'error\'',
)


def _limits(spark, sf_dir):
    rows = _log(spark, sf_dir, {"error": "rate_limited", "purchase": "ended", "click": "response", "view": "response", "signup": "other"})
    return rows.withColumns({"status": F.when(F.col("seq") % 2 == 0, 200).otherwise(500), "delay": F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("seq") % 100)})


register(
    "rate_limit_episodes", lambda s, d: eventlog.rate_limit_episodes(_limits(s, d), ["id"]),
    """WITH m AS (SELECT user_id AS id, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS "at", event_type AS e, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END AS delay,
                  sum(CASE WHEN event_type = 'purchase' OR (event_type IN ('click', 'view') AND event_id % 2 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ep FROM events)
       SELECT id, arg_min("at", seq) AS since, max("at" + coalesce(delay, 60)) AS until, count(*) AS n FROM m WHERE e = 'error' GROUP BY id, ep""",
)
register(
    "backoff", lambda s, d: _log(s, d).select("seq", eventlog.backoff((F.col("seq") % 8).cast("int"), F.when(F.col("seq") % 2 == 1, F.col("at") % 900)).alias("pause")),
    """SELECT event_id AS seq, least(600, greatest(CASE WHEN event_id % 2 = 1 THEN epoch(date_trunc('second', ts))::BIGINT % 900 ELSE 0 END, 60 * 2 ** least(event_id % 8, 4)))::BIGINT AS pause FROM events""",
)
register(
    "policy_matrix", lambda s, d: _log(s, d).select("seq", eventlog.decide(F.col("event") == "failed", F.col("requires_approval"), F.col("dismiss")).alias("outcome")),
    "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'report' WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'awaiting_approval' ELSE 'ready' END AS outcome FROM events",
)
register("activity", lambda s, d: eventlog.activity(_log(s, d)).select("seq", "id", "event"), "SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'failed' ELSE 'expanded' END AS event FROM events ORDER BY event_id DESC LIMIT 100")

# --- claims and sync --------------------------------------------------------------------------------------------------

_on_obs("claims", lambda s, d: planner.claims(_live(s, d), LO, HI, 5, _A).groupBy("artist").agg(F.sum("n").alias("n"), F.sum(F.col("claim_end") - F.col("claim_start")).alias("seconds"), F.min("claim_start").alias("first"), F.max("claim_end").alias("last")), f"SELECT artist, count(*) AS n, {HI - LO}::BIGINT AS seconds, {LO}::BIGINT AS first, {HI}::BIGINT AS last FROM live WHERE uts >= {LO} AND uts < {HI} GROUP BY artist")
_on_obs(
    "claim_batches", lambda s, d: planner.claims(_live(s, d), LO, HI, 5, _A),
    f"""SELECT artist, batch, coalesce(lag(claim_end) OVER (PARTITION BY artist ORDER BY batch), {LO})::BIGINT AS claim_start, claim_end, n FROM (SELECT artist, batch, coalesce(max(CASE WHEN closed THEN uts + 1 END), {HI})::BIGINT AS claim_end, max(n)::BIGINT AS n FROM fo GROUP BY artist, batch)""",
    f"sec AS (SELECT artist, uts, count(*) AS c, row_number() OVER (PARTITION BY artist ORDER BY uts) AS k, max(uts) OVER (PARTITION BY artist) AS last FROM live WHERE uts >= {LO} AND uts < {HI} GROUP BY artist, uts)",
    """fo AS (WITH RECURSIVE f AS (SELECT artist, k, uts, c AS n, 0::BIGINT AS batch, c >= 5 AND uts <> last AS closed FROM sec WHERE k = 1
        UNION ALL SELECT s.artist, s.k, s.uts, CASE WHEN f.n >= 5 THEN s.c ELSE f.n + s.c END, f.batch + (f.n >= 5)::BIGINT, CASE WHEN f.n >= 5 THEN s.c ELSE f.n + s.c END >= 5 AND s.uts <> s.last FROM f JOIN sec s ON s.artist = f.artist AND s.k = f.k + 1) SELECT * FROM f)""",
)
_on_obs(
    "spot_chunks", lambda s, d: planner.chunks(_live(s, d), 7, _A).groupBy("artist", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("uts").alias("first_uts")),
    "SELECT artist, (rn - 1) // 7 AS batch, count(*) AS n, min(uts) AS first_uts FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY uts, id) AS rn FROM live) GROUP BY ALL",
)


def _paged(spark, sf_dir):
    """Each artist's plays as pages of ten, the newest first."""
    order = Window.partitionBy("artist").orderBy(F.desc("uts"), F.desc("id"))
    rows = _live(spark, sf_dir).withColumn("page_number", F.floor((F.row_number().over(order) - 1) / 10) + 1)
    facts = rows.groupBy("artist", "page_number").agg(F.min("uts").alias("oldest"))
    return facts.withColumns({"total_pages": F.max("page_number").over(Window.partitionBy("artist")), "to": F.lit(NOW).cast("long")})


_on_obs(
    "sync_confirmed", lambda s, d: sync.confirmed(_paged(s, d), HOLE, _A),
    f"""SELECT artist, page_number, CASE WHEN c THEN {HOLE} ELSE low + 1 END::BIGINT AS claim_start, {NOW}::BIGINT AS claim_end, c AS complete
        FROM (SELECT *, min(oldest) OVER w AS low, bool_or(oldest < {HOLE} OR page_number >= tp) OVER w AS c FROM pf WINDOW w AS (PARTITION BY artist ORDER BY page_number)) WHERE CASE WHEN c THEN {HOLE} ELSE low + 1 END < {NOW}""",
    "pg AS (SELECT *, (row_number() OVER (PARTITION BY artist ORDER BY uts DESC, id DESC) - 1) // 10 + 1 AS page_number FROM live)",
    "pf AS (SELECT *, max(page_number) OVER (PARTITION BY artist) AS tp FROM (SELECT artist, page_number, min(uts) AS oldest FROM pg GROUP BY ALL))",
)

# --- releases ---------------------------------------------------------------------------------------------------------


def _releases(spark, sf_dir) -> DataFrame:
    """Orders as releases of the parts in them."""
    n = F.col("o_orderkey")
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    rows = li.join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey"), "o_orderkey").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    pick = lambda m, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % m + 1).cast("int"))
    return rows.select(
        F.col("l_partkey").alias("key"), F.concat(n.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.col("p_name"), pick(4, ["", " (Deluxe)", "", " Live"])).alias("title"), "p_name",
        F.when(n % 13 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), pick(5, ["US", "JP", "GB", "JP", None]).alias("country"), pick(7, [None, "demo", "deluxe edition", "", "bonus disc", None, "clean"]).alias("disambiguation"),
        pick(6, ["Official", None, "Promotion", "Bootleg", "Official", "Withdrawn"]).alias("status"), pick(3, ["Album", "Single", "EP"]).alias("primary_type"),
        F.when(n % 9 == 0, F.array(F.lit("Live"))).otherwise(F.array().cast("array<string>")).alias("secondary_types"), F.array(F.when(n % 10 == 0, F.element_at(F.array(*[F.lit(v) for v in ("Various Artists", "VA", "various", "V/A")]), (F.floor(n / 10) % 4 + 1).cast("int"))).otherwise("Someone")).alias("artist_credit"),
        (n * 10 + F.col("l_linenumber")).alias("pos"),
    )


_REL = """rel AS (SELECT l_partkey AS key, o_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, p_name || ['', ' (Deluxe)', '', ' Live'][o_orderkey % 4 + 1] AS title, p_name,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, ['US', 'JP', 'GB', 'JP', NULL][o_orderkey % 5 + 1] AS country, [NULL, 'demo', 'deluxe edition', '', 'bonus disc', NULL, 'clean'][o_orderkey % 7 + 1] AS dis,
  ['Official', NULL, 'Promotion', 'Bootleg', 'Official', 'Withdrawn'][o_orderkey % 6 + 1] AS status, ['Album', 'Single', 'EP'][o_orderkey % 3 + 1] AS typ, o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 AS comp, o_orderkey * 10 + l_linenumber AS pos
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
rx AS (SELECT *, coalesce(contains(dis, 'deluxe') OR contains(dis, 'bonus'), false) AS spec, coalesce(contains(dis, 'demo'), false) AS demo, date[:4] AS yr, coalesce(date[:4]::INT, 9999) AS yn, coalesce(country = 'JP', false) AS jp, coalesce(country = 'US', false) AS us FROM rel)"""
register(
    "canonical_release", lambda s, d: releases.canonical_release(_releases(s, d), ["key"]).select("key", "id", "title", "date"),
    f"""WITH {_REL}, a AS (SELECT *, bool_and(spec OR demo) OVER (PARTITION BY key) AS every FROM rx), b AS (SELECT *, min(yn) OVER (PARTITION BY key) AS y0 FROM a WHERE NOT (spec OR demo) OR every)
        SELECT key, id, title, date FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY spec, NOT spec AND jp, NOT spec AND NOT us, yr NULLS LAST, pos) AS rn FROM b WHERE yn - y0 <= 1) WHERE rn = 1""",
)
register(
    "matching_release", lambda s, d: releases.matching_release(_releases(s, d), ["key"], "p_name").select("key", "id", "date"),
    f"WITH {_REL} SELECT key, id, date FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY spec, NOT spec AND jp, yr NULLS LAST, pos) AS rn FROM rx WHERE lower(title) = lower(p_name)) WHERE rn = 1",
)
_RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'Official' THEN 0 WHEN 'Promotion' THEN 2 WHEN 'Bootleg' THEN 3 ELSE CASE WHEN status IS NULL THEN 1 ELSE 5 END END, comp, contains(title, 'Deluxe'),
  CASE typ WHEN 'Album' THEN 0 WHEN 'EP' THEN 1 ELSE 2 END, date[:4]::INT NULLS LAST, pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY pos) AS nth FROM rx) WHERE nth = 1)"""
register("release_rank", lambda s, d: releases.ranked(_releases(s, d), ["key"]).select("key", "id", "rank"), f"WITH {_REL}, {_RANKED} SELECT key, id, rank FROM rk")


def _precedes(a: str, b: str) -> str:
    early = "{0}.typ = 'Single' AND {1}.typ = 'Album' AND {0}.y < 9999 AND {1}.y < 9999 AND {0}.y + 10 <= {1}.y"
    head, rest = "row({0}.s, {0}.c, {0}.e)", "row({0}.t, {0}.y, {0}.pos)"
    return f"CASE WHEN {head.format(a)} <> {head.format(b)} THEN {head.format(a)} < {head.format(b)} WHEN {early.format(a, b)} THEN true WHEN {early.format(b, a)} THEN false ELSE {rest.format(a)} < {rest.format(b)} END"


def _gap(spark, sf_dir) -> DataFrame:
    """The orders' dates cover seven years, so every other release is taken to be twelve years older."""
    older = (F.substring("date", 1, 4).cast("int") - 12 * (F.floor(F.col("pos") / 10) % 2)).cast("string")
    return releases.ranked_with_gap(_releases(spark, sf_dir).withColumn("date", older), ["key"])


register(
    "release_rank_gap", _gap,
    f"""WITH {_REL}, {_RANKED}, st AS (SELECT *, CASE status WHEN 'Official' THEN 0 WHEN 'Promotion' THEN 2 WHEN 'Bootleg' THEN 3 ELSE CASE WHEN status IS NULL THEN 1 ELSE 5 END END AS s FROM rk),
        li AS (SELECT key, list([{{'s': s, 'c': comp, 'e': contains(title, 'Deluxe'), 't': CASE typ WHEN 'Album' THEN 0 WHEN 'EP' THEN 1 ELSE 2 END, 'y': coalesce(date[:4]::INT - 12 * (pos // 10 % 2), 9999), 'pos': pos, 'typ': typ, 'id': id, 'title': title}}] ORDER BY s, pos) AS l
               FROM st GROUP BY key),
        cut AS (SELECT key, list_reduce(l, lambda h, x: h[:coalesce(list_max(list_transform(h, lambda e, i: CASE WHEN {_precedes("x[1]", "e")} THEN 0 ELSE i END)), 0)] || x
                 || h[coalesce(list_max(list_transform(h, lambda e, i: CASE WHEN {_precedes("x[1]", "e")} THEN 0 ELSE i END)), 0) + 1:]) AS o FROM li)
        SELECT key, o[i].id AS id, o[i].title AS title, i AS rank FROM (SELECT key, o, unnest(generate_series(1, len(o))) AS i FROM cut)""",
)
register(
    "release_replacement", lambda s, d: releases.replacement(_releases(s, d).withColumn("album", F.when(F.col("key") % 2 == 0, F.col("p_name")).otherwise("Other")), ["key"], "album").select("key", "id", "title"),
    f"""WITH {_REL}, {_RANKED}, f AS (SELECT *, bool_or(lower(title) = lower(p_name) AND key % 2 = 0 AND NOT comp) OVER (PARTITION BY key) AS fine FROM rk)
        SELECT key, id, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS rn FROM f WHERE NOT fine AND NOT comp AND (key % 2 = 1 OR lower(title) <> lower(p_name))) WHERE rn = 1""",
)
_SIM = """CASE WHEN lower({a}) = lower({b}) THEN 1.0 ELSE len(list_filter(string_split(lower({a}), ''), lambda c: c <> '' AND contains(lower({b}), c)))::DOUBLE / greatest(strlen({a}), strlen({b})) - 0.5 * abs(strlen({a}) - strlen({b})) / greatest(strlen({a}), strlen({b})) END"""


def _candidates(spark, sf_dir):
    a = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return a.select("p_partkey", releases.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"), releases.confidence(F.col("p_name"), F.col("p_name"), F.col("p_name"), F.col("p_type")).alias("confidence"))


register("similarity", lambda s, d: _candidates(s, d), f"SELECT p_partkey, x::DOUBLE AS similarity, ((1.0 + x) / 2)::DOUBLE AS confidence FROM (SELECT p_partkey, {_SIM.format(a='p_name', b='p_type')} AS x FROM part)")


def _matched(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("pos"), releases.similarity(F.col("p_name"), F.col("p_type")).alias("confidence"))
    return releases.best_matches(rows, ["key"], 0.2).select("key", "pos")


register("best_match", _matched, f"SELECT key, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x DESC, pos) AS rn FROM (SELECT p_brand AS key, p_partkey AS pos, {_SIM.format(a='p_name', b='p_type')} AS x FROM part) WHERE x >= 0.2) WHERE rn = 1")

# --- pages ------------------------------------------------------------------------------------------------------------


def _bodies(spark, sf_dir) -> DataFrame:
    """Live plays of each artist as JSON pages: of two thirds as arrays, of the others as bare objects; some rows play just now."""
    plays = _live(spark, sf_dir)
    track = F.concat(F.lit('{"name":"'), F.col("track"), F.lit('","artist":{"#text":"'), F.col("artist"), F.lit('"},"album":{"#text":"'), F.coalesce("album", F.lit("")), F.lit('"}'), F.when(F.col("seq") % 70 == 0, ',"@attr":{"nowplaying":"true"}').otherwise(F.concat(F.lit(',"date":{"uts":"'), F.col("uts").cast("string"), F.lit('"}'))), F.lit("}"))
    head = F.concat(F.lit(',"@attr":{"page":"'), F.col("seq").cast("string"), F.lit('","totalPages":"5000"}}}'))
    body = F.concat(F.lit('{"recenttracks":{"track":'), F.when(F.col("seq") % 30 == 0, track).otherwise(F.concat(F.lit("["), track, F.lit(","), track, F.lit("]"))), head)
    return plays.select(F.when(F.col("seq") % 110 == 0, '{"error":6,"message":"User not found"}').otherwise(body).alias("body"))


_on_obs(
    "api_page_parse", lambda s, d: pages.api_tracks(_bodies(s, d)).groupBy("page_number", "name", "artist", "album", "timestamp").agg(F.count(F.lit(1)).alias("n")),
    "SELECT seq::INT AS page_number, track AS name, artist, nullif(coalesce(album, ''), '') AS album, uts AS timestamp, CASE WHEN seq % 30 = 0 THEN 1 ELSE 2 END::BIGINT AS n FROM live WHERE seq % 70 <> 0 AND seq % 110 <> 0",
)
_on_obs(
    "api_page_heads", lambda s, d: pages.api_pages(_bodies(s, d)).groupBy("has_next", "error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tracks")).alias("tracks")),
    """SELECT seq % 110 <> 0 AND seq < 5000 AS has_next, CASE WHEN seq % 110 = 0 THEN 'error 6: User not found' END AS error, count(*) AS n, sum(CASE WHEN seq % 110 = 0 THEN 0 WHEN seq % 30 = 0 THEN 1 ELSE 2 END)::BIGINT AS tracks FROM live GROUP BY ALL""",
)
register(
    "page_links", lambda s, d: _table(s, d, "pages").select("page_id", F.explode(pages.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")),
    """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
)
register(
    "pagination_total",
    lambda s, d: _table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit(None)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("Page 1 of "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit('<a href="?page=3">3</a> <a href="?page='), F.col("page_id").cast("string"), F.lit('" rel="next">x</a>'))).alias("p")).select("page_id", pages.total_pages(F.col("p")).cast("long").alias("total"), pages.has_next(F.col("p")).alias("more")),
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN page_id ELSE greatest(3, page_id) END::BIGINT AS total, page_id % 4 > 1 AS more FROM pages",
)
register(
    "url_parts", lambda s, d: _table(s, d, "pages").select("page_id", pages.request_parts(F.col("url")).alias("r")).select("page_id", F.col("r.path").alias("path"), F.try_element_at("r.query", F.lit("page")).alias("page")),
    r"""SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM pages""",
)


def _charts(spark, sf_dir) -> DataFrame:
    """Plays as HTML pages of a chart table."""
    ship(spark)
    row = F.concat(F.lit('<tr data-timestamp="'), F.col("uts").cast("string"), F.lit('"><td class="chartlist-name"><a href="#">'), F.col("track"), F.lit('</a></td><td class="chartlist-artist"><a>'), F.col("artist"), F.lit('</a></td><td><form data-edit-scrobble><input name="album_name" value="'), F.coalesce("album", F.lit("")), F.lit('"></form><span class="chartlist-count-bar-value">1,234 plays</span></td></tr>'))
    plays = _live(spark, sf_dir).select(F.col("seq").alias("page"), row.alias("row"))
    return pages.recent_plays(plays.select("page", F.concat(F.lit('<table class="chartlist"><tbody>'), F.col("row"), F.lit("</tbody></table>")).alias("html")))


_on_obs("html_chart_rows", lambda s, d: _charts(s, d).select("page", "name", "artist", "timestamp", "album", "playcount"), "SELECT seq AS page, track AS name, artist, uts AS timestamp, nullif(coalesce(album, ''), '') AS album, 1234::BIGINT AS playcount FROM live")
_on_obs(
    "edit_response",
    lambda s, d: _obs(s, d).select("seq", pages.edit_outcome(F.concat(F.lit("<p>"), "track", F.lit("</p>"), F.when(F.col("seq") % 3 == 0, '<div class="alert alert-success">ok</div>').when(F.col("seq") % 3 == 1, '<div class="alert-success"></div><p class="alert-danger">no</p>').otherwise("<p>")), F.when(F.col("seq") % 5 < 4, 200).otherwise(500)).alias("r")).select("seq", "r.success", "r.message"),
    """SELECT seq, seq % 3 = 0 AND seq % 5 < 4 AS success, CASE WHEN seq % 3 = 1 THEN 'edit failed' WHEN seq % 3 = 0 AND seq % 5 < 4 THEN 'edit successful' ELSE 'edit failed with status ' || CASE WHEN seq % 5 < 4 THEN '200' ELSE '500' END END AS message FROM obs""",
)

from playlake import service_queries  # noqa: E402, F401  (registers its queries)
