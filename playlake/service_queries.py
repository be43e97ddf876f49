"""More registered queries: pages of the service, catalogue look-ups, decisions, reports, texts; and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.functions import rule_table, rules, texts
from playlake.operators import eventlog, interval, query, reconcile, releases, store, subjects
from playlake.plans import passes, planner, providers, sync
from playlake.queries import (
    _A, _CHAIN, _CHAINED, _INST, _LOG, _PLAIN, _REL, _ST, _STATE, HI, HOLE, LO, NOW, _coverage, _dismissed, _edits, _instances, _intents, _live, _log, _obs, _on_obs, _paged, _planned, _releases, _table, _titles, register,
)
from playlake.folders import new_folder
from playlake.shipping import ship
from playlake.sources import listings, page_scan, pages, state

_COLS = ", ".join(_PLAIN)

# --- store ------------------------------------------------------------------------------------------------------------


def _one_play(spark, sf_dir) -> DataFrame:
    """The look-up of one id, the middle one of all."""
    obs = _obs(spark, sf_dir)
    play = obs.agg(F.min(F.when(F.col("seq") % 97 == 0, F.col("id")))).first()[0]
    return store.point_lookup(obs, play).select(*_PLAIN)


_on_obs("point_lookup_by_id", _one_play, f"SELECT {_COLS} FROM cur WHERE id = (SELECT min(id) FROM obs WHERE seq % 97 = 0)")
_on_obs("artist_plays_range", lambda s, d: query.artist_plays(_live(s, d), "artist_3", LO, HI).select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE artist = 'artist_3' AND uts >= {LO} AND uts < {HI}")
_on_obs("album_feed", lambda s, d: query.album_plays(_live(s, d), "album_2").select(*_PLAIN), f"SELECT {_COLS} FROM live WHERE album = 'album_2'")
_on_obs("artists_unlimited", lambda s, d: query.limited(_live(s, d).groupBy("artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artist"), 0), "SELECT artist, count(*) AS n FROM live GROUP BY artist")
register("latest_decisions", lambda s, d: query.latest_first(_intents(s, d), 40).select("id", "state", "updated_at"), f"{_ST} SELECT id, state, updated_at FROM st ORDER BY updated_at DESC, id LIMIT 40")


def _edit_states(spark, sf_dir):
    return eventlog.fold_edit_log(_log(spark, sf_dir, {"signup": "queued", "error": "failed", "purchase": "applied", "click": "failed", "view": "other"}))


_on_obs(
    "store_status_edits", lambda s, d: query.store_status(_live(s, d), _coverage(s, d), NOW, _edit_states(s, d)).select("n", "segments", "edits", "pending"),
    """SELECT (SELECT count(*) FROM live) AS n, (SELECT count(*) FROM cov) AS segments, count(DISTINCT ok.id) AS edits, count(DISTINCT ok.id) FILTER (WHERE ok.id NOT IN (SELECT id FROM ok WHERE e = 'purchase')) AS pending FROM ok""", _LOG,
)
_on_obs(
    "library_drill", lambda s, d: query.library(_live(s, d, LO, HI), 5, _coverage(s, d), "artist_4").filter("kind like 'span%' or kind = 'covered' or kind like 'drill%'"),
    """SELECT 'span_start' AS kind, NULL AS artist, NULL AS name, min(start) AS n FROM cov UNION ALL SELECT 'span_end', NULL, NULL, max("end") FROM cov UNION ALL SELECT 'covered', NULL, NULL, sum("end" - start)::BIGINT FROM cov
       UNION ALL (SELECT 'drill_track', artist, track, count(*) AS n FROM w GROUP BY artist, track ORDER BY n DESC, artist, track LIMIT 5) UNION ALL (SELECT 'drill_album', artist, album, count(*) AS n FROM w WHERE album <> '' GROUP BY artist, album ORDER BY n DESC, artist, album LIMIT 5)""",
    f"w AS (SELECT * FROM live WHERE uts >= {LO} AND uts < {HI} AND artist = 'artist_4')",
)
_on_obs("activity_lines", lambda s, d: state.lines(_live(s, d).select("id", "album"), "play"), """SELECT '{"event":"play","id":"' || id || '"' || CASE WHEN album IS NULL THEN '' ELSE ',"album":"' || album || '"' END || '}' AS line FROM live""")

# --- intervals and sync -----------------------------------------------------------------------------------------------

_ALL = """one1 AS (SELECT *, CASE WHEN start <= max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM cov),
one AS (SELECT min(start) AS start, max("end") AS "end", min(verified_at) AS verified_at FROM (SELECT *, sum(brk) OVER (ORDER BY start, "end") AS g FROM one1) GROUP BY g)"""


def _whole(spark, sf_dir) -> DataFrame:
    """All artists' coverage as one map."""
    return interval.normalise(_coverage(spark, sf_dir).select("start", "end", "verified_at"))


_on_obs(
    "fill_order", lambda s, d: sync.fill_order(_whole(s, d), LO, HI),
    f"""SELECT start, "end", row_number() OVER (ORDER BY "end" DESC) - 1 AS place FROM (SELECT greatest(before, {LO})::BIGINT AS start, least(start, {HI})::BIGINT AS "end" FROM b) WHERE start < "end\"""",
    _ALL, """b AS (SELECT start, coalesce(lag("end") OVER (ORDER BY start), 0) AS before FROM (SELECT start, "end" FROM one UNION ALL SELECT 9000000000, 9000000001))""",
)
_on_obs("extend_window", lambda s, d: sync.extend_window(_whole(s, d), None, NOW), f'SELECT max("end") AS start, {NOW - sync.MARGIN}::BIGINT AS "end" FROM one HAVING max("end") < {NOW - sync.MARGIN}', _ALL)
_on_obs(
    "invalidate", lambda s, d: sync.invalidate(_whole(s, d), LO, HOLE)[0],
    f"""SELECT start, least("end", {LO})::BIGINT AS "end", verified_at FROM one WHERE start < {LO} UNION ALL SELECT greatest(start, {HOLE})::BIGINT, "end", verified_at FROM one WHERE "end" > {HOLE} AND NOT (start < {LO} AND "end" <= {HOLE})""", _ALL,
)
_on_obs("history_start", lambda s, d: sync.history_start(_live(s, d), None, 0, True), "SELECT min(uts) AS history_start FROM live")


def _upstream(spark, sf_dir) -> DataFrame:
    """All live plays as pages of fifty of the service, the newest first, some with a title changed."""
    plays = _live(spark, sf_dir)
    day = F.floor(F.col("uts") / 86400)
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    rows = plays.withColumn("day", day)
    before = rows.groupBy("day").agg(F.count(F.lit(1)).alias("c")).select("day", F.coalesce(F.sum("c").over(later), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("uts"), F.desc("id")))
    rows = rows.withColumn("rn", within).join(before, "day")
    return rows.select(*[c for c in plays.columns if c not in ("album", "fetched_at")], F.when(F.col("seq") % 9 == 0, "new").otherwise(F.col("album")).alias("album"), (F.col("fetched_at") + F.when(F.col("seq") % 9 == 0, 10).otherwise(0)).alias("fetched_at"), (F.floor((F.col("before") + F.col("rn") - 1) / 50) + 1).alias("page_number"), F.ceil(F.col("total") / 50).alias("total_pages"))


_UP = """up AS (SELECT *, (row_number() OVER (ORDER BY uts DESC, id DESC) - 1) // 50 + 1 AS page FROM live),
pgs AS (SELECT page, min(uts) AS oldest, max(page) OVER () AS pages FROM up GROUP BY page),
rd AS (SELECT page FROM (SELECT *, coalesce(bool_or(oldest < {lo} OR page >= pages) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM pgs) WHERE NOT done)""".replace("{lo}", str(LO))
_on_obs(
    "sync_report", lambda s, d: sync.sync_report(_upstream(s, d), _obs(s, d), _whole(s, d).filter(F.col("end") < LO), LO, NOW).select("pages", "n_new", "n_updated", "n_unchanged"),
    f"SELECT (SELECT count(*) FROM rd) AS pages, 0::BIGINT AS n_new, count(*) FILTER (WHERE seq % 9 = 0) AS n_updated, count(*) FILTER (WHERE seq % 9 <> 0) AS n_unchanged FROM up JOIN rd USING (page) WHERE uts >= {LO} AND uts < {NOW - sync.MARGIN}", _UP,
)
_on_obs("sync_pass_rows", lambda s, d: sync.pass_rows(_upstream(s, d), LO).groupBy("page_number").agg(F.count(F.lit(1)).alias("n")), "SELECT page AS page_number, count(*) AS n FROM up JOIN rd USING (page) GROUP BY page", _UP)
_on_obs(
    "verify_report", lambda s, d: reconcile.verify_report(_obs(s, d).filter("seq % 5 > 0"), store.classify_append(_obs(s, d), _upstream(s, d).drop("page_number", "total_pages")), reconcile.verify(_obs(s, d), _obs(s, d).filter("seq % 5 > 0"), LO, HI, NOW)),
    f"""SELECT (SELECT count(*) FROM obs WHERE seq % 5 > 0) AS upstream_count, (SELECT count(*) FROM live WHERE seq % 9 = 0) AS written, (SELECT count(*) FROM live WHERE uts >= {LO} AND uts < {HI} AND id NOT IN (SELECT id FROM obs WHERE seq % 5 > 0)) AS tombstoned""",
)
_on_obs(
    "delete_report", lambda s, d: reconcile.delete_report(reconcile.bulk_delete(_live(s, d, LO, HI), _obs(s, d).filter("seq % 3 = 0").groupBy("id").agg(F.max(F.col("seq") % 2 == 0).alias("success")))),
    f"""SELECT count(*) AS found, count(*) FILTER (WHERE s) AS deleted, count(*) FILTER (WHERE NOT s) AS failed FROM live l LEFT JOIN (SELECT id, bool_or(seq % 2 = 0) AS s FROM obs WHERE seq % 3 = 0 GROUP BY id) r ON l.id = r.id WHERE uts >= {LO} AND uts < {HI}""",
)
_on_obs(
    "delete_pages", lambda s, d: query.pages_between(_upstream(s, d), 2, 3).select("id", "page_number"), "SELECT id, page AS page_number FROM up WHERE page BETWEEN 2 AND 3", _UP,
)
_on_obs("page_bounds", lambda s, d: pages.page_bounds(_upstream(s, d).withColumn("timestamp", F.col("uts"))), "SELECT page AS page_number, count(*) AS n, min(uts) AS oldest, max(uts) AS newest FROM up GROUP BY page", _UP)
_on_obs("until_stop", lambda s, d: pages.until_stop(_live(s, d).withColumn("timestamp", F.col("uts")), HOLE - HOLE % 3600).select("id"), f"SELECT id FROM live WHERE uts > {HOLE - HOLE % 3600}")
_on_obs("clip_to_pin", lambda s, d: pages.clip_to_pin(_live(s, d).select("id", F.when(F.col("seq") % 7 > 0, F.col("uts")).alias("timestamp")), HOLE).select("id"), f"SELECT id FROM live WHERE seq % 7 = 0 OR uts < {HOLE}")
_on_obs(
    "planner_feed", lambda s, d: planner.feed(_live(s, d), _whole(s, d), _coverage(s, d).filter("artist in ('artist_1', 'artist_2')").withColumnRenamed("artist", "provider"), LO, HI).select("id"),
    f"""SELECT id FROM live l WHERE uts >= {LO} AND uts < {HI} AND EXISTS (SELECT 1 FROM one WHERE l.uts >= start AND l.uts < "end") AND EXISTS (SELECT 1 FROM (VALUES ('artist_1'), ('artist_2')) p(a) WHERE a IN (SELECT artist FROM cov) AND NOT EXISTS (SELECT 1 FROM cov c WHERE c.artist = a AND l.uts >= c.start AND l.uts < c."end"))""", _ALL,
)



def _planning(spark, sf_dir):
    """A pass over what all artists' coverage has of a range, with an empty queue and nothing seen before."""
    ship(spark)
    none = spark.createDataFrame([], "start long, `end` long, verified_at long")
    intents, _, _ = passes.planning_pass(_live(spark, sf_dir), _CHAIN, _whole(spark, sf_dir), none, spark.createDataFrame([], passes.QUEUE), LO, HI, NOW)
    return intents.select("artist", "track", "album", "n", "new_track", "new_artist", "new_album", "outcome")


_on_obs(
    "planning_pass", _planning,
    """SELECT artist, track, album, n, new_track, new_artist, new_album, CASE WHEN confirm THEN 'awaiting_approval' ELSE 'ready' END AS outcome FROM c3 WHERE new_track <> track OR new_artist <> artist OR new_album IS DISTINCT FROM album""",
    _ALL, f"""sp AS (SELECT artist, track, album, count(*) AS n, max(uts) AS latest_uts FROM live l WHERE uts >= {LO} AND uts < {HI} AND EXISTS (SELECT 1 FROM one WHERE l.uts >= start AND l.uts < "end") GROUP BY ALL)""",
    _CHAINED.replace("FROM subj WHERE latest_uts % 7200 <> 0", "FROM sp"),
)

_MID = (LO + HI) // 2


def _providers_pass(spark, sf_dir) -> DataFrame:
    """Rules, a catalogue and compilations over the whole window; the catalogue has seen its first half."""
    live = _live(spark, sf_dir)
    matches = live.filter(F.col("artist").like("artist_1_")).select("artist", "track").distinct().select("artist", "track", F.col("artist").alias("m_artist"), F.concat("track", F.lit("*")).alias("m_title"), F.lit(None).cast("string").alias("m_album"))
    none = F.lit(None).cast("string")

    def release(place: int, title, credit, kinds) -> DataFrame:
        known = live.filter("album = 'album_2'").select("artist", "track", "album").distinct()
        return known.select("artist", "track", "album", F.lit(str(place)).alias("id"), title.alias("title"), F.array(credit).alias("artist_credit"), F.lit("2001").alias("date"), none.alias("country"), F.lit("Official").alias("status"),
                            none.alias("disambiguation"), F.lit("Album").alias("primary_type"), kinds.cast("array<string>").alias("secondary_types"), F.lit(place).alias("pos"))

    held = release(0, F.col("album"), F.lit("Various Artists"), F.array(F.lit("Compilation"))).unionByName(release(1, F.concat(F.lit("Own "), "track"), F.col("artist"), F.array()))
    seen = spark.createDataFrame([("catalogue", LO, _MID, 1)], "provider string, start long, `end` long, verified_at long")
    asked = [providers.by_rules(_CHAIN), providers.by_catalogue(matches), providers.off_compilations(held)]
    found = providers.plan_with(live, asked, _whole(spark, sf_dir), seen, spark.createDataFrame([], passes.QUEUE), LO, HI, NOW, new_folder(spark, "suggestions"))
    return found.intents.select("artist", "track", "album", "n", "provider", "new_track", "new_artist", "new_album", "outcome")


_SEEN_BY = 'SELECT artist, track, album, count(*) AS n, max(uts) AS latest_uts FROM live l WHERE uts >= {0} AND uts < {1} AND EXISTS (SELECT 1 FROM one WHERE l.uts >= start AND l.uts < "end") GROUP BY ALL'
_on_obs(
    "planning_providers", _providers_pass,
    """SELECT artist, track, album, n, provider, new_track, new_artist, new_album, CASE WHEN confirm THEN 'awaiting_approval' ELSE 'ready' END AS outcome
       FROM (SELECT *, row_number() OVER (PARTITION BY artist, track, album ORDER BY rank) AS rn FROM told) WHERE rn = 1""",
    _ALL, f"sp AS ({_SEEN_BY.format(LO, HI)})", f"half AS ({_SEEN_BY.format(_MID, HI)})", _CHAINED.replace("FROM subj WHERE latest_uts % 7200 <> 0", "FROM sp"),
    """told AS (SELECT 0 AS rank, 'rules' AS provider, artist, track, album, n, new_track, new_artist, new_album, confirm FROM c3 WHERE new_track <> track OR new_artist <> artist OR new_album IS DISTINCT FROM album
       UNION ALL SELECT 1, 'catalogue', artist, track, album, n, track || '*', artist, album, false FROM half WHERE artist LIKE 'artist_1_'
       UNION ALL SELECT 2, 'compilations', artist, track, album, n, track, artist, 'Own ' || track, true FROM sp WHERE album = 'album_2')""",
)

# --- stored pages -----------------------------------------------------------------------------------------------------

_SPAN = 5 * 86400


def _stored(spark, sf_dir) -> str:
    """All live plays as pages of five days, the newest first, stored as files."""
    plays = _live(spark, sf_dir).withColumn("page_number", 10_000 - F.floor(F.col("uts") / _SPAN))
    track = F.struct(F.col("track").alias("name"), F.struct(F.col("artist").alias("#text")).alias("artist"), F.struct(F.coalesce("album", F.lit("")).alias("#text")).alias("album"), F.struct(F.col("uts").cast("string").alias("uts")).alias("date"))
    found = plays.groupBy("page_number").agg(F.min("uts").alias("oldest"), F.max("uts").alias("newest"), F.sort_array(F.collect_list(F.struct("uts", "id", track.alias("t"))), False).alias("rows"))
    head = F.struct(F.col("page_number").cast("string").alias("page"), F.lit("10000").alias("totalPages"))
    body = F.to_json(F.struct(F.struct(F.transform("rows", lambda r: r["t"]).alias("track"), head.alias("@attr")).alias("recenttracks")))
    folder = new_folder(spark, "pages")
    page_scan.store_pages(found.select("page_number", "oldest", "newest", body.alias("body")), folder)
    return folder


_PAGES = f"pg AS (SELECT *, min(uts) OVER p AS oldest, max(uts) OVER p AS newest FROM live WINDOW p AS (PARTITION BY uts // {_SPAN}))"
_COLUMNS = "10000 - uts // {0} AS page_number, track AS name, artist, nullif(coalesce(album, ''), '') AS album, uts AS timestamp".format(_SPAN)
_on_obs(
    "page_window", lambda s, d: page_scan.window(s, _stored(s, d), LO, HI).select(F.col("page_number").cast("long").alias("page_number"), "name", "artist", "album", "timestamp"),
    f"SELECT {_COLUMNS} FROM pg WHERE newest >= {LO} - 1 AND oldest < {HI} AND uts < {HI}", _PAGES,
)
_on_obs(
    "page_feed_newer", lambda s, d: page_scan.newer_than(s, _stored(s, d), LO).select(F.col("page_number").cast("long").alias("page_number"), "name", "artist", "album", "timestamp"),
    f"SELECT {_COLUMNS} FROM pg WHERE newest > {LO} AND uts > {LO}", _PAGES,
)

# --- decisions and reports --------------------------------------------------------------------------------------------


def _requests(spark, sf_dir):
    """All of the log as requests for decisions."""
    op = F.when(F.col("seq") % 3 == 0, "approve").when(F.col("seq") % 3 == 1, "reject").otherwise("reinstate")
    return _log(spark, sf_dir).select((F.col("id") % 400).alias("id"), op.alias("op"), F.col("seq").alias("at"), (F.col("seq") % 8 == 0).alias("dismiss"))


_RQ = """rq AS (SELECT user_id % 400 AS id, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'reinstate' END AS op, event_id AS "at", event_id % 8 = 0 AS dis, row_number() OVER (PARTITION BY user_id % 400 ORDER BY event_id) AS i FROM events)"""
register(
    "guarded_decisions", lambda s, d: eventlog.guarded(_requests(s, d), _intents(s, d)).select("at", "op", "event", "dismissed", "error"),
    f"""WITH RECURSIVE {_STATE}, {_RQ},
        step AS (SELECT id, 0::BIGINT AS i, state, appr, state = 'rejected' AND dismissed AS was, NULL::BIGINT AS "at", NULL::VARCHAR AS op, false AS ok, NULL::VARCHAR AS found, NULL::BOOLEAN AS entry FROM st
          UNION ALL SELECT id, i, CASE WHEN NOT ok THEN found WHEN op = 'approve' THEN 'ready' WHEN op = 'reject' THEN 'rejected' WHEN appr THEN 'awaiting_approval' ELSE 'ready' END AS state, appr,
                 CASE WHEN ok AND op = 'reject' THEN dis WHEN ok AND op = 'reinstate' THEN false ELSE was END AS was, "at", op, ok, found, CASE WHEN ok AND op = 'reject' AND dis THEN true WHEN ok AND op = 'reinstate' AND was THEN false END AS entry
          FROM (SELECT rq.*, step.state AS found, appr, was, CASE rq.op WHEN 'approve' THEN step.state = 'awaiting_approval' WHEN 'reject' THEN step.state IN ('awaiting_approval', 'ready', 'in_progress') ELSE step.state = 'rejected' END AS ok
                FROM step JOIN rq ON rq.id = step.id AND rq.i = step.i + 1))
        SELECT "at", op, CASE WHEN ok THEN CASE op WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'reinstated' END END AS event, entry AS dismissed, CASE WHEN NOT ok THEN 'can''t ' || op || ' what is ' || found END AS error FROM step WHERE i > 0
        UNION ALL SELECT "at", op, NULL, NULL, 'not found' FROM rq WHERE id NOT IN (SELECT id FROM st)""",
)


def _proposals(spark, sf_dir):
    return eventlog.fold_rules(_log(spark, sf_dir, {"signup": "proposed", "click": "approved", "error": "rejected", "view": "seen", "purchase": "seen"}))


register(
    "guarded_rules", lambda s, d: eventlog.guarded_rules(_requests(s, d).withColumn("op", F.when(F.col("op") == "approve", "approve").otherwise("reject")), _proposals(s, d)).select("at", "event", "joins", "error"),
    f"""WITH {_LOG}, {_RQ}, pr AS (SELECT id, coalesce(CASE arg_max(e, seq) FILTER (WHERE e IN ('click', 'error')) WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected' END, 'pending') AS state FROM ok GROUP BY id),
        told AS (SELECT rq.id, "at", i, state, CASE op WHEN 'approve' THEN 'approved' ELSE 'rejected' END AS e FROM rq LEFT JOIN pr USING (id)),
        first AS (SELECT id, e AS decided FROM told WHERE i = 1)
        SELECT "at", CASE WHEN state = 'pending' AND i = 1 THEN e END AS event, coalesce(state = 'pending' AND i = 1 AND e = 'approved', false) AS joins,
               CASE WHEN state IS NULL THEN 'not found' WHEN state <> 'pending' THEN 'is ' || state WHEN i > 1 THEN 'is ' || decided END AS error FROM told LEFT JOIN first USING (id)""",
)
_on_obs(
    "plan_counts", lambda s, d: planner.plan_report(subjects.without(subjects.group_by_subject(_live(s, d)), _dismissed(s, d)), _planned(s, d)),
    """SELECT (SELECT count(*) FROM ch) AS subjects_seen, count(*) AS suggestions, count(*) FILTER (WHERE NOT confirm) AS queued_ready, count(*) FILTER (WHERE confirm) AS queued_awaiting_approval, 0::BIGINT AS reported_only, 0::BIGINT AS rules_proposed
       FROM c3 WHERE new_track <> track OR new_artist <> artist OR new_album IS DISTINCT FROM album""", _CHAINED,
)
register(
    "execution_report", lambda s, d: planner.execution_report(eventlog.completion(_instances(s, d), s.range(3).select(F.col("id").cast("string")), 2), _instances(s, d)),
    f"""WITH {_INST}, oc AS (SELECT id, CASE WHEN bool_and(status = 'applied' OR instance = '3') THEN 'completed' WHEN bool_and(status = 'applied' OR (status = 'failed' AND attempts >= 2) OR instance = '3') THEN 'abandoned' ELSE 'open' END AS o FROM inst GROUP BY id)
        SELECT count(*) AS intents_processed, count(*) FILTER (WHERE o = 'completed') AS intents_completed, count(*) FILTER (WHERE o = 'abandoned') AS intents_abandoned, (SELECT count(*) FROM inst WHERE status = 'applied') AS instances_applied, (SELECT count(*) FROM inst WHERE status = 'failed') AS instances_failed FROM oc""",
)
register(
    "retry_delay", lambda s, d: _log(s, d).select("seq", eventlog.retry_delay((F.col("seq") % 7).cast("int"), F.when(F.col("seq") % 2 == 1, F.col("at") % 300)).alias("pause")),
    "SELECT event_id AS seq, least(600, CASE WHEN event_id % 2 = 1 THEN epoch(date_trunc('second', ts))::BIGINT % 300 ELSE 0 END + 30 * 2 ** (event_id % 7))::BIGINT AS pause FROM events",
)
_on_obs("any_rule", lambda s, d: _edits(s, d).select("id", rules.any_rule(_CHAIN).alias("hit")), "SELECT id, regexp_matches(track, '^track_[0-4]$') OR coalesce(regexp_matches(nullif(album, ''), 'album_\\d'), false) AS hit FROM live")
_on_obs(
    "catalogue_clean_up", lambda s, d: rules.without_pattern(_live(s, d), r"_\d$", "artist_5"), "SELECT DISTINCT artist, track, regexp_replace(track, '_\\d$', '') AS new_track FROM live WHERE artist = 'artist_5'",
)


def _long_list() -> list:
    """Two thousand rules for single titles, and three that build on them."""
    each = [{"track_name": {"find": f"^track_{k}$", "replace": f"Track {k}"}} for k in range(2000)]
    more = [{"track_name": {"find": r"^Track (\d)$", "replace": "T$1"}, "artist_name": {"find": "artist_1", "replace": "One"}, "requires_confirmation": True}, {"album_name": {"find": "^ALBUM_[12]$", "replace": "Twin", "flags": "i"}}, {"track_name": {"find": "T7|Track 8", "replace": ""}}]
    return rules.rules_from_rows([*each, *more])


_on_obs(
    "rule_table", lambda s, d: rule_table.apply_table(subjects.group_by_subject(_live(s, d)), _long_list()).select("artist", "track", "album", "new_track", "new_artist", "new_album", "confirm"),
    """SELECT artist, track, album, CASE WHEN hit AND track = 'track_7' THEN '' WHEN hit THEN 'T' || track[-1] WHEN track = 'track_8' THEN '' ELSE 'Track ' || track[-1] END AS new_track, CASE WHEN hit THEN 'One' ELSE artist END AS new_artist,
              CASE WHEN album IN ('album_1', 'album_2') THEN 'Twin' ELSE album END AS new_album, hit AS confirm FROM (SELECT *, contains(artist, 'artist_1') AS hit FROM subj)""",
)
_on_obs(
    "claims_whole", lambda s, d: planner.claims(_live(s, d), LO, HI, 50),
    f"""SELECT batch, claim_start, CASE WHEN batch = (SELECT max(batch) FROM w) THEN {HI} ELSE seen END::BIGINT AS claim_end, n FROM w""",
    f"""sc AS (SELECT uts, count(*)::BIGINT AS n, row_number() OVER (ORDER BY uts) AS i FROM live WHERE uts >= {LO} AND uts < {HI} GROUP BY uts),
        st0 AS (SELECT 0::BIGINT AS i, 0::BIGINT AS batch, {LO}::BIGINT AS claim_start, 0::BIGINT AS n, {LO}::BIGINT AS seen),
        cut AS (WITH RECURSIVE r AS (SELECT * FROM st0 UNION ALL SELECT sc.i, CASE WHEN r.n >= 50 THEN batch + 1 ELSE batch END, CASE WHEN r.n >= 50 THEN seen ELSE claim_start END, CASE WHEN r.n >= 50 THEN sc.n ELSE r.n + sc.n END, sc.uts + 1 FROM r JOIN sc ON sc.i = r.i + 1) SELECT * FROM r),
        w AS (SELECT batch, min(claim_start) AS claim_start, arg_max(n, i)::BIGINT AS n, max(seen)::BIGINT AS seen FROM cut GROUP BY batch)""",
)
_on_obs(
    "edit_summaries",
    lambda s, d: _live(s, d).withColumns({"album_artist": F.lit(None).cast("string"), "timestamp": F.col("uts")}).select("id", subjects.summary_text(subjects.with_artist(subjects.track_edit(F.col("track"), F.col("artist"), F.col("album"), F.col("timestamp")), F.when(F.col("seq") % 2 == 0, F.col("artist")).otherwise("Other"))).alias("by_track"), subjects.summary_text(subjects.artist_edit(F.col("artist"), F.lit("artist_3"))).alias("by_artist"), subjects.summary_text(subjects.no_op_edit()).alias("none")),
    """SELECT id, CASE WHEN seq % 2 = 1 THEN 'artist: ''' || artist || ''' -> ''Other''; album artist: - -> ''Other''' ELSE 'album artist: - -> ''' || artist || '''' END AS by_track,
              CASE WHEN artist <> 'artist_3' THEN 'artist: ''' || artist || ''' -> ''artist_3''; ' ELSE '' END || 'album artist: - -> ''artist_3''' AS by_artist, 'no changes' AS none FROM live""",
)
_on_obs(
    "edit_ids", lambda s, d: _live(s, d).select("id", texts.edit_id(F.col("uts"), F.concat_ws("/", "artist", "track"), F.col("seq")).alias("edit_id"), texts.time_text(F.col("uts")).alias("at")),
    "SELECT id, 'e' || uts::VARCHAR || '-' || substr(sha256(artist || '/' || track), 1, 8) || '-' || seq::VARCHAR AS edit_id, strftime(make_timestamp(uts * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM live",
)
register(
    "time_arguments", lambda s, d: _table(s, d, "orders").select("o_orderkey", texts.time_of(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderstatus"))).alias("uts")),
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT END AS uts FROM orders",
)

# --- pages ------------------------------------------------------------------------------------------------------------


def _cell(field: str, value) -> Column:
    return F.concat(F.lit(f'<td class="chartlist-{field}"><a href="/music/x/'), value, F.lit('">'), value, F.lit("</a></td>"))


def _bar(value) -> Column:
    return F.concat(F.lit('<td class="chartlist-count-bar"><span class="chartlist-count-bar-value">'), value, F.lit(" plays</span></td>"))


def _row(*cells, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<tr {attrs}>"), *cells, F.lit("</tr>"))


def _table_of(*rows) -> Column:
    return F.concat(F.lit('<table class="chartlist"><tbody>'), *rows, F.lit("</tbody></table>"))


def _page_rows(spark, sf_dir, html, *more) -> DataFrame:
    """One page for each live play: page, html and more columns."""
    ship(spark)
    return _live(spark, sf_dir).select(F.col("seq").alias("page"), html.alias("html"), *more)


def _n() -> Column:
    return F.col("seq").cast("string")


def _track_pages(spark, sf_dir):
    """A track named by an element, with its row's count; and a second track in a row alone, without an artist."""
    named = F.concat(F.lit('<i data-track-name="'), F.col("track"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit('" data-artist-name="'), F.col("artist"))).otherwise(""), F.lit('"></i>'))
    html = F.concat(named, _table_of(_row(_cell("name", F.col("track")), _bar(F.when(F.col("seq") % 3 == 0, "many").otherwise(_n()))), _row(_cell("name", F.lit("other")), _bar(F.lit("12")))))
    return _page_rows(spark, sf_dir, html, F.lit("Page").alias("artist"), F.col("album"))


_on_obs(
    "track_listing", lambda s, d: listings.track_listing(_track_pages(s, d)),
    """SELECT seq AS page, 0 AS place, track AS name, CASE WHEN seq % 2 = 0 THEN artist ELSE 'Page' END AS artist, album, seq AS playcount FROM live WHERE seq % 3 <> 0
       UNION ALL SELECT seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END, 'other', 'Page', album, 12 FROM live""",
)


def _album_pages(spark, sf_dir):
    """Of two pages in three the album is named by an element, of the others by rows only."""
    title = F.coalesce(F.nullif("album", F.lit("")), F.lit("none"))
    html = F.concat(F.when(F.col("seq") % 3 > 0, F.concat(F.lit('<i data-album-name="'), title, F.lit('"></i>'))).otherwise(""), _table_of(_row(_cell("name", title), _bar(_n())), _row(_cell("name", F.lit("B-sides")))))
    return _page_rows(spark, sf_dir, html, F.col("artist"))


_on_obs(
    "album_listing", lambda s, d: listings.album_listing(_album_pages(s, d)),
    """SELECT seq AS page, 0 AS place, coalesce(nullif(album, ''), 'none') AS name, artist, seq AS playcount FROM live UNION ALL SELECT seq, 1, 'B-sides', artist, 1 FROM live WHERE seq % 3 = 0""",
)
_on_obs(
    "artist_listing", lambda s, d: listings.artist_listing(_page_rows(s, d, _table_of(_row(_cell("name", F.col("artist")), _bar(F.format_number(F.col("seq") + 1000, 0)), attrs='class="js-link-block"'), _row(_cell("name", F.col("track")))))),
    "SELECT seq AS page, 0 AS place, artist AS name, seq + 1000 AS playcount FROM live",
)


def _search_pages(spark, sf_dir):
    inputs = F.concat(F.lit('<td><input name="album" value=" '), F.coalesce("album", F.lit("")), F.lit(' "></td>'))
    return _page_rows(spark, sf_dir, _table_of(_row(_cell("name", F.col("track")), F.when(F.col("seq") % 4 > 0, _cell("artist", F.col("artist"))).otherwise(""), inputs, _bar(_n()))))


_on_obs("search_tracks", lambda s, d: listings.search_results(_search_pages(s, d), "tracks"), "SELECT seq AS page, 0 AS place, track AS name, artist, nullif(coalesce(album, ''), '') AS album, NULL::VARCHAR AS album_artist, seq AS playcount FROM live WHERE seq % 4 > 0")
_on_obs("search_albums", lambda s, d: listings.search_results(_search_pages(s, d), "albums").select("page", "name", "artist", "playcount"), "SELECT seq AS page, track AS name, artist, seq AS playcount FROM live WHERE seq % 4 > 0")
_on_obs("search_artists", lambda s, d: listings.search_results(_search_pages(s, d), "artists").select("page", "name", "playcount"), "SELECT seq AS page, track AS name, seq AS playcount FROM live")
_on_obs(
    "listing_page", lambda s, d: listings.listing_page(_upstream(s, d).withColumn("place", F.row_number().over(Window.partitionBy("page_number").orderBy(F.desc("uts"), F.desc("id"))) - 1), 65, 20, 50).select("id", "page_number", "place"),
    "SELECT id, page AS page_number, (g - 1) % 50 AS place FROM (SELECT *, row_number() OVER (ORDER BY uts DESC, id DESC) AS g FROM up) WHERE g > 65 AND g <= 85", _UP,
)


def _album_tracks(spark, sf_dir):
    plays = _live(spark, sf_dir).filter(query.has_album())
    albums = plays.groupBy("artist", "album").agg(F.min("seq").alias("album_place"))
    tracks = plays.groupBy("artist", "album", F.col("track").alias("name")).agg(F.count(F.lit(1)).alias("playcount"))
    order = Window.partitionBy("artist", "album").orderBy(F.desc("playcount"), "name")
    tracks = tracks.withColumns({"page_number": F.floor((F.row_number().over(order) - 1) / 5) + 1, "place": (F.row_number().over(order) - 1) % 5})
    return listings.tracks_of_albums(albums, tracks)


_on_obs(
    "artist_tracks", _album_tracks,
    """SELECT artist, album, album_place, rn - 1 AS place, name, playcount FROM (SELECT artist, album, track AS name, count(*) AS playcount, row_number() OVER (PARTITION BY artist, album ORDER BY count(*) DESC, track) AS rn FROM live WHERE album <> '' GROUP BY artist, album, track)
       JOIN (SELECT artist, album, min(seq) AS album_place FROM live WHERE album <> '' GROUP BY ALL) USING (artist, album) WHERE rn <= 5""",
)


def _form(track, artist, album, album_artist=None) -> Column:
    field = lambda n, v: F.concat(F.lit(f'<input name="{n}" value="'), v, F.lit('">'))
    more = [field("album_artist_name", album_artist)] if album_artist is not None else []
    return F.concat(F.lit("<tr><td><form data-edit-scrobble>"), field("track_name", track), field("artist_name", artist), field("album_name", album), *more, field("timestamp", F.col("uts").cast("string")), F.lit("</form></td></tr>"))


def _variations(spark, sf_dir):
    """Pages are told apart by their track's name, so that each has variations of its own."""
    own = F.concat("track", F.lit(" no. "), _n())
    html = _table_of(F.when(F.col("seq") % 4 > 0, _form(own, F.col("artist"), F.coalesce("album", F.lit("")))).otherwise(""), _form(F.lit("else"), F.lit("who"), F.lit("where"), F.lit("VA")))
    return listings.edit_variations(_page_rows(spark, sf_dir, html, own.alias("track"), F.col("artist"), F.lit(1).alias("page_number")))


_on_obs(
    "edit_variations", _variations,
    """SELECT track || ' no. ' || seq::VARCHAR AS track, artist, 0 AS pos, CASE WHEN seq % 4 > 0 THEN track || ' no. ' || seq::VARCHAR ELSE 'else' END AS form_track, CASE WHEN seq % 4 > 0 THEN artist ELSE 'who' END AS form_artist,
              CASE WHEN seq % 4 > 0 THEN coalesce(album, '') ELSE 'where' END AS album, CASE WHEN seq % 4 > 0 THEN artist ELSE 'VA' END AS album_artist, uts AS timestamp FROM live""",
)
_on_obs(
    "edited_names",
    lambda s, d: listings.edited_names(_page_rows(s, d, F.when(F.col("seq") % 2 == 0, _table_of(_row(_cell("name", F.col("track")), _cell("album", F.col("artist"))))).otherwise(F.concat(F.lit('<a href="/music/'), "artist", F.lit('/The+'), F.translate("track", "_", "-"), F.lit('">x</a>'))))),
    "SELECT seq AS page, CASE WHEN seq % 2 = 0 THEN track END AS track, CASE WHEN seq % 2 = 0 THEN artist ELSE 'The ' || replace(track, '_', '-') END AS album FROM live",
)
register(
    "limits_in_answers",
    lambda s, d: _table(s, d, "pages").select("page_id", pages.rate_limited(F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 3 == 0, "Please SLOW down").when(F.col("page_id") % 3 == 1, "You're requesting a lot of pages").otherwise("")), F.when(F.col("page_id") % 5 == 0, 429).when(F.col("page_id") % 5 < 3, 200).otherwise(503)).alias("limited"), listings.logged_out(F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 7 == 0, '<a href="/login?next=/x">').otherwise(""))).alias("out")),
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 < 3 THEN page_id % 3 = 1 OR contains(lower(coalesce(html, '')), 'you''re requesting a lot of pages')
              ELSE page_id % 3 = 0 OR regexp_matches(lower(coalesce(html, '')), 'you''ve tried to log in too many times|you''re requesting too many pages|slow down|too fast|rate limit|throttled|temporarily blocked|temporarily restricted|captcha|verify you''re human|prove you''re not a robot|security check|service temporarily unavailable|quota exceeded|limit exceeded|daily limit') END AS limited,
              page_id % 7 = 0 OR contains(coalesce(html, ''), '/login?next=') AS out FROM pages""",
)
register(
    "form_texts", lambda s, d: _table(s, d, "pages").select("page_id", pages.form_text(pages.form_fields(F.concat(F.lit("b=x+y&a="), F.col("page_id").cast("string"), F.lit("&b=z%21")))).alias("form")), "SELECT page_id, 'a=' || page_id::VARCHAR || '&b=z%21' AS form FROM pages",
)

# --- catalogue --------------------------------------------------------------------------------------------------------

register(
    "best_release", lambda s, d: releases.best_release(_releases(s, d).withColumn("album", F.when(F.col("key") % 2 == 0, F.col("p_name"))), ["key"], "album").select("key", "id", "title"),
    f"""WITH {_REL} SELECT key, id, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY own DESC, own AND spec, CASE WHEN own AND spec THEN false ELSE jp END, yr NULLS LAST, pos) AS rn FROM (SELECT *, key % 2 = 0 AND lower(title) = lower(p_name) AS own FROM rx)) WHERE rn = 1""",
)
register(
    "eligible_releases",
    lambda s, d: _releases(s, d).select("id", "key", releases.eligible(F.col("artist_credit"), F.col("status"), True).alias("eligible"), releases.unofficial(F.col("status")).alias("unofficial"), releases.catalogue_edition(F.col("title")).alias("edition"), releases.rank_reason().alias("reason")),
    f"""WITH {_REL} SELECT id, key, pos // 10 % 10 <> 0 AND coalesce(status = 'Official', true) AS eligible, coalesce(status = 'Bootleg', false) AS unofficial, contains(lower(title), 'deluxe') AS edition,
        lower(coalesce(status, 'no status')) || ', ' || CASE WHEN comp THEN 'compilation' ELSE 'no compilation' END || ', ' || CASE WHEN contains(lower(title), 'deluxe') THEN 'special edition' ELSE 'regular edition' END || ', ' || lower(typ) || ', ' || coalesce(yr::INT::VARCHAR, 'no year') AS reason FROM rx""",
)
register(
    "off_compilations", lambda s, d: releases.off_compilations(_releases(s, d).withColumn("album", F.when(F.col("key") % 3 == 0, F.col("p_name")).when(F.col("key") % 3 == 1, "Other")), ["key"], "album"),
    f"""WITH {_REL}, rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'Official' THEN 0 WHEN 'Promotion' THEN 2 WHEN 'Bootleg' THEN 3 ELSE CASE WHEN status IS NULL THEN 1 ELSE 5 END END, comp, contains(title, 'Deluxe'),
          CASE typ WHEN 'Album' THEN 0 WHEN 'EP' THEN 1 ELSE 2 END, date[:4]::INT NULLS LAST, pos) AS rank, CASE key % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Other' END AS album FROM rx WHERE key % 3 < 2),
        f AS (SELECT *, bool_or(lower(title) = lower(album) AND NOT comp) OVER (PARTITION BY key) AS fine FROM rk)
        SELECT key, title AS new_album, true AS confirm FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS rn FROM f WHERE NOT fine AND NOT comp AND lower(title) <> lower(album)) WHERE rn = 1""",
)


def _existing(spark, sf_dir):
    """Parts as tracks of albums that are named like the parts; of even orders the part is on it."""
    rel = _releases(spark, sf_dir).withColumn("artist", F.col("key").cast("string"))
    contents = rel.filter("pos % 20 < 10").select(F.col("id").alias("release_id"), F.col("p_name").alias("title"))
    parts = _table(spark, sf_dir, "part")
    tracks = parts.select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("artist"), F.upper("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("album"))
    known = parts.filter("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("artist"), F.col("p_name").alias("title"))
    return releases.track_exists(tracks, rel, contents, known)


register(
    "track_exists", _existing,
    f"""WITH {_REL}, own AS (SELECT * FROM rx WHERE lower(title) = lower(p_name)), a AS (SELECT *, bool_and(spec OR demo) OVER (PARTITION BY key) AS every FROM own), b AS (SELECT *, min(yn) OVER (PARTITION BY key) AS y0 FROM a WHERE NOT (spec OR demo) OR every),
        c AS (SELECT key, pos // 10 % 2 = 0 AS has FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY spec, NOT spec AND jp, NOT spec AND NOT us, yr NULLS LAST, pos) AS rn FROM b WHERE yn - y0 <= 1) WHERE rn = 1)
        SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN coalesce(has, false) ELSE p_size % 2 = 0 END AS exists FROM part LEFT JOIN c ON key = p_partkey""",
)
_on_obs(
    "corrections",
    lambda s, d: releases.corrections(_live(s, d).select("id", "artist", F.col("track").alias("name"), "album"), _live(s, d).select("id", F.concat("artist", F.when(F.col("seq") % 3 == 0, "!").otherwise(" ")).alias("m_artist"), F.col("track").alias("m_title"), F.when(F.col("seq") % 2 == 0, "Found").alias("m_album"))),
    """SELECT id, CASE WHEN seq % 3 = 0 OR (album IS NOT NULL AND seq % 2 = 0) THEN 'edit' ELSE 'no_action' END AS kind, CASE WHEN seq % 3 = 0 THEN artist || '!' ELSE artist END AS new_artist, track AS new_track, CASE WHEN seq % 2 = 0 THEN 'Found' ELSE coalesce(album, '') END AS new_album, false AS confirm FROM live""",
)


def _named(spark, sf_dir):
    rows = _releases(spark, sf_dir).withColumns({"a": F.lit("someone"), "b": F.col("p_name")})
    return releases.albums_named(rows, ["key"], "a", "b", 0.9).select("key", "place", "release_id", "found_artist", "title")


register(
    "albums_named", _named,
    f"""WITH {_REL}, s AS (SELECT *, CASE WHEN pos // 10 % 10 = 0 THEN ['Various Artists', 'VA', 'various', 'V/A'][(pos // 100) % 4 + 1] ELSE 'Someone' END AS who FROM rx WHERE coalesce(status <> 'Bootleg', true)),
        x AS (SELECT *, CASE WHEN lower(title) = lower(p_name) THEN 1.0::DOUBLE ELSE len(list_filter(string_split(lower(title), ''), lambda c: c <> '' AND contains(lower(p_name), c)))::DOUBLE / greatest(strlen(title), strlen(p_name)) - 0.5 * abs(strlen(title) - strlen(p_name)) / greatest(strlen(title), strlen(p_name)) END AS st,
                     CASE WHEN lower(who) = 'someone' THEN 1.0::DOUBLE ELSE len(list_filter(string_split(lower(who), ''), lambda c: c <> '' AND contains('someone', c)))::DOUBLE / greatest(strlen(who), 7) - 0.5 * abs(strlen(who) - 7) / greatest(strlen(who), 7) END AS sa FROM s),
        y AS (SELECT *, (sa + st) / 2 AS conf FROM x WHERE (sa + st) / 2 >= 0.9), z AS (SELECT *, lag(title) OVER w IS NOT DISTINCT FROM title AND lag(who) OVER w IS NOT DISTINCT FROM who AS same FROM y WINDOW w AS (PARTITION BY key ORDER BY conf DESC, pos))
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY conf DESC, pos) - 1 AS place, id AS release_id, who AS found_artist, title FROM z WHERE NOT same""",
)
register(
    "stacked_suffixes", lambda s, d: _titles(s, d).select("p_partkey", rules.without_suffixes(F.concat("title", F.lit(" (2004 Mix) [Digitally Remastered]"))).alias("clean"), rules.without_suffixes(F.concat("p_name", F.lit(" of 1969"))).alias("kept")),
    "SELECT p_partkey, p_name AS clean, p_name || ' of 1969' AS kept FROM part",
)
