"""A planning pass over uncovered history, and a cycle of sync, merge and planning on a folder of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from playlake.functions.rules import FIELDS, RewriteRule, rules_from_rows, rules_hash
from playlake.functions.texts import number_of
from playlake.operators import eventlog, interval
from playlake.operators.subjects import KEY
from playlake.plans import planner, sync
from playlake.sources import state
from playlake.sources.plays import read_log, write_log

QUEUE = "id string, seq long, at long, event string, requires_approval boolean, dismiss boolean, artist string, track string, album string, album_artist string, " + ", ".join(f"new_{f} string" for f in FIELDS)


def planning_pass(plays: DataFrame, rules: list[RewriteRule], synced: DataFrame, coverage: DataFrame, queue: DataFrame, start: int, end: int, now: int, provider: str = "rules", dry_run: bool = False, needs_approval: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the rules make of the plays that they haven't seen: (intents, events to add to the queue, the provider's coverage afterwards).

    ``synced``: the store's ranges; ``coverage``: the provider's; ``queue``: the log so far, whose open and dismissed
    subjects are left alone.  A dry run queues and claims nothing.
    """
    subjects = queue.filter("event = 'created'").select("id", *KEY)
    folded = eventlog.fold_queue(queue).join(subjects, "id")
    busy = folded.filter(F.col("state").isin(*eventlog.OPEN)).select(*KEY)
    dismissed = folded.filter("dismissed").select(*KEY)
    own = coverage.withColumn("provider", F.lit(provider))
    work = interval.subtract(interval.clip(synced, start, end), coverage).withColumn("verified_at", F.lit(now).cast("long"))
    seen = interval.contains(plays, work, [])
    intents = planner.plan(seen, rules, dismissed, busy, dry_run, needs_approval)
    told = F.to_json(F.struct(*KEY, *[f"new_{f}" for f in FIELDS]))
    # Where a log is read, events are ordered by seq; an intent's first one needs none beside it in the same second.
    events = intents.filter("outcome <> 'report'").select(
        number_of(F.lit(now), told).alias("id"), F.lit(now).cast("long").alias("seq"), F.lit(now).cast("long").alias("at"), F.lit("created").alias("event"), (F.col("outcome") == "awaiting_approval").alias("requires_approval"),
        F.lit(False).alias("dismiss"), *KEY, *[f"new_{f}" for f in FIELDS],
    )
    after = planner.claimed(own, work.withColumn("provider", F.lit(provider)), dry_run=dry_run).drop("provider")
    return intents, events, after


def cycle(spark: SparkSession, path: str, pages: DataFrame, start: int, now: int, provider: str = "rules", **policy) -> DataFrame:
    """One round of continuous mode below ``path``: fetched pages into the log, the log into the view, the rules over what is new, the outcome into the queue.

    ``pages``: the service's answer as :func:`playlake.plans.sync.sync_pass` takes it.  The result is the plan's report.  Each step's
    state is written before the next begins, and all of them fold by last write or by id, so a round that breaks off is begun anew.
    """
    from playlake.streaming.merge import View, run_available

    files = state.StateFiles(spark, path)
    log = read_log(spark, f"{path}/log") if "log" in files.names() else pages.drop("page_number", "total_pages").limit(0)
    fresh, coverage = sync.sync_pass(pages, log, state.load_coverage(spark, path), start, now)
    write_log(fresh, f"{path}/log")
    state.save_coverage(spark, path, coverage)
    run_available(spark, f"{path}/log", f"{path}/view", f"{path}/merged")
    rows = state.load_rules(spark, path)
    known, now_hash = state.load_state(spark, path).get("rules_hash"), rules_hash(rows)
    own = planner.reset_coverage(state.load_coverage(spark, path, provider).withColumn("provider", F.lit(provider)), known or now_hash, now_hash, provider).drop("provider")
    queue = state.read_events(spark, f"{path}/queue", QUEUE) if "queue" in files.names() else spark.createDataFrame([], QUEUE)
    plays = View(spark, f"{path}/view").read().filter("not deleted")
    intents, events, after = planning_pass(plays, rules_from_rows(rows), state.load_coverage(spark, path), own, queue, start, now, now, provider, **policy)
    told = planner.report(intents).collect()  # a row per outcome
    state.append_events(events, f"{path}/queue")
    state.save_coverage(spark, path, after, provider)
    state.save_state(spark, path, rules_hash=now_hash, last_sync_at=now)
    return spark.createDataFrame(told, "outcome string, subjects long, plays long")
