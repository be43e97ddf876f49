"""Folds of event logs, and what is read off the folded states.

Queue and edit logs are folded by window functions over each id's events: what a state machine keeps between events is
written as conditions on the last event of some kind.  So a fold stays in the JVM, and an id with many events spills
like any window instead of gathering in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TERMINAL = ("applied", "rejected", "abandoned")
OPEN = ("awaiting_approval", "ready", "in_progress")
EXECUTABLE = ("ready", "in_progress")


def _since_created(events: DataFrame, created: str) -> DataFrame:
    """Each id's events from its first ``created`` one on; later ones of that kind, and ids without one, are left out."""
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("__created", F.count_if(F.col("event") == created).over(upto))
    first = (F.col("__created") == 1) & (F.coalesce(F.lag("__created").over(Window.partitionBy("id").orderBy("seq")), F.lit(0)) == 0)
    return seen.withColumn("__first", first).filter((F.col("__created") >= 1) & (F.col("__first") | (F.col("event") != created)))


def fold_edit_log(events: DataFrame) -> DataFrame:
    """Events (id, seq, at, event: queued, failed, applied, cancelled, error?) → id, state, attempts, last_error, created_at, updated_at, place.

    Failures count while the edit is pending; the last terminal event decides; ``place`` orders ids by their first event.
    """
    kept = _since_created(events, "queued")
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("event").isin("applied", "cancelled")
    pending = F.coalesce(F.max(ended).over(upto), F.lit(False)) == F.lit(False)
    kept = kept.withColumn("__counts", (F.col("event") == "failed") & pending)
    return kept.groupBy("id").agg(
        F.coalesce(F.max_by("event", F.when(ended, F.col("seq"))), F.lit("pending")).alias("state"),
        F.count_if("__counts").alias("attempts"), F.max_by("error", F.when(F.col("__counts"), F.col("seq"))).alias("last_error"),
        F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("updated_at"), F.min("seq").alias("place"),
    )


def fold_queue(events: DataFrame) -> DataFrame:
    """Events of edit intents → id, state, requires_approval, dismissed, created_at, updated_at, place.

    Events (id, seq, at, event, requires_approval?, dismiss?): created, approved, rejected, reinstated, expanded, completed, abandoned, applied, failed.

    completed, abandoned and rejected set the state whatever it was.  After the last of these, only what it allows can
    happen: reinstated after rejected, by the last such event; then approved, then expanded.
    """
    kept = _since_created(events, "created")
    approval = F.max(F.when(F.col("__first"), F.col("requires_approval"))).over(Window.partitionBy("id"))
    kept = kept.withColumn("__approval", F.coalesce(approval, F.lit(False)))
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def last(kind: Column) -> Column:
        return F.max(F.when(kind, F.col("seq"))).over(upto)

    e = F.col("event")
    kept = kept.withColumn("__end", last(e.isin("completed", "abandoned", "rejected"))).withColumn("__end_event", F.last(F.when(e.isin("completed", "abandoned", "rejected"), e), ignorenulls=True).over(upto))
    # A reinstatement counts if the intent is rejected just then; it opens the intent anew.
    reopens = (e == "reinstated") & (F.col("__end_event") == "rejected")
    kept = kept.withColumn("__opened", F.coalesce(last(reopens | F.col("__first")), F.lit(-1)))
    # Only the first reinstatement after a rejection counts: later ones meet an open intent.
    order = Window.partitionBy("id").orderBy("seq")
    again = reopens & (F.lag("__opened").over(order) > F.coalesce(F.col("__end"), F.lit(-1)))
    kept = kept.withColumn("__opens", F.col("__first") | (reopens & ~F.coalesce(again, F.lit(False))))
    whole = Window.partitionBy("id")
    kept = kept.withColumns({
        "__last_end": F.max(F.when(e.isin("completed", "abandoned", "rejected"), F.col("seq"))).over(whole),
        "__last_open": F.max(F.when(F.col("__opens"), F.col("seq"))).over(whole),
    })
    kept = kept.withColumn("__from", F.greatest(F.col("__last_open"), F.coalesce(F.col("__last_end"), F.lit(-1))))
    kept = kept.withColumn("__approved", F.min(F.when((e == "approved") & (F.col("seq") > F.col("__last_open")), F.col("seq"))).over(whole))
    ready_from = F.when(F.col("__approval"), F.col("__approved")).otherwise(F.col("__last_open"))
    # Expanding moves an intent on only if it is executable at that moment.
    kept = kept.withColumn("__runs", (e == "expanded") & (F.col("seq") > ready_from))
    s = kept.groupBy("id").agg(
        F.max("__approval").alias("requires_approval"), F.max("__last_end").alias("e"), F.max("__last_open").alias("o"), F.max("__approved").alias("a"), F.max(F.coalesce("__runs", F.lit(False))).alias("r"),
        F.max_by("event", F.when(e.isin("completed", "abandoned", "rejected"), F.col("seq"))).alias("end_event"), F.max_by("dismiss", F.when(e == "rejected", F.col("seq"))).alias("dismiss"),
        F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("updated_at"), F.min("seq").alias("place"),
    )
    ended = F.col("e").isNotNull() & (F.col("e") > F.col("o"))
    opened = F.when(F.col("requires_approval") & F.col("a").isNull(), "awaiting_approval").when(F.col("r"), "in_progress").otherwise("ready")
    state = F.when(ended, F.when(F.col("end_event") == "completed", "applied").otherwise(F.col("end_event"))).otherwise(opened)
    return s.select("id", state.alias("state"), "requires_approval", F.when(state == "rejected", F.coalesce("dismiss", F.lit(False))).otherwise(False).alias("dismissed"), "created_at", "updated_at", "place")


def fold_instances(events: DataFrame) -> DataFrame:
    """(id, seq, event: expanded, applied, failed, instance, error?, edit_id?) → one row per intent and instance: status, attempts, last_error.

    Failures count from the last success on; expanding again changes nothing.
    """
    told = events.filter(F.col("event").isin("expanded", "applied", "failed") & F.col("instance").isNotNull())
    told = told.withColumn("__rank", F.when(F.col("event") != "expanded", F.col("seq")))
    applied = F.max(F.when(F.col("event") == "applied", F.col("seq"))).over(Window.partitionBy("id", "instance"))
    told = told.withColumn("__since", F.coalesce(applied, F.lit(-1)))
    failed = (F.col("event") == "failed") & (F.col("seq") > F.col("__since"))
    return told.groupBy("id", "instance").agg(
        F.coalesce(F.max_by("event", "__rank"), F.lit("pending")).alias("status"), F.count_if(failed).alias("attempts"),
        F.max_by("error", F.when(failed, F.col("seq"))).alias("last_error"),
    )


def instance_progress(instances: DataFrame) -> DataFrame:
    return instances.groupBy("id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("applied", "failed", "pending")])


def completion(instances: DataFrame, live_ids: DataFrame, max_attempts: int) -> DataFrame:
    """Per intent: completed if all its instances that still live are applied, abandoned if the rest are out of attempts, else open."""
    held = instances.join(live_ids.select(F.col("id").alias("instance")), "instance", "left_semi")
    done, spent = F.col("status") == "applied", (F.col("status") == "failed") & (F.col("attempts") >= max_attempts)
    s = held.groupBy("id").agg(F.every(done).alias("all_done"), F.every(done | spent).alias("none_left"))
    ids = instances.select("id").distinct().join(s, "id", "left")
    return ids.select("id", F.when(F.coalesce("all_done", F.lit(True)), "completed").when(F.col("none_left"), "abandoned").otherwise("open").alias("outcome"))


def fold_rules(events: DataFrame) -> DataFrame:
    """Proposed rules (id, seq, at, event: proposed, approved, rejected) → id, state, at; the first proposal counts, then the last decision."""
    kept = _since_created(events, "proposed")
    decided = F.col("event").isin("approved", "rejected")
    return kept.groupBy("id").agg(F.coalesce(F.max_by("event", F.when(decided, F.col("seq"))), F.lit("pending")).alias("state"), F.min_by("at", "seq").alias("at"))


def fold_dismissed(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry of each subject, if it is active; of equal times the later in the log."""
    order = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("seq"))
    last = events.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return last.filter(F.coalesce("active", F.lit(True)))


def execution_order(intents: DataFrame) -> DataFrame:
    """What may run, what runs already first, then in order of creation."""
    return intents.filter(F.col("state").isin(*EXECUTABLE)).orderBy(F.col("state") != "in_progress", "place")


def review_status() -> Column:
    s = F.col("state")
    return F.when(s == "awaiting_approval", "needs_review").when(s.isin(*EXECUTABLE, "applied"), "approved").when(s == "rejected", F.when(F.col("dismissed"), "dismissed").otherwise("rejected")).otherwise("closed")


def work_status() -> Column:
    s = F.col("state")
    return F.when(s == "awaiting_approval", "waiting").when(s == "ready", "queued").when(s == "in_progress", "running").when(s == "applied", "done").otherwise("off")


def work_queue_totals(intents: DataFrame, progress: DataFrame) -> DataFrame:
    """One row over executable intents: how many, not expanded yet, instances by status."""
    rows = intents.filter(F.col("state").isin(*EXECUTABLE)).join(progress, "id", "left")
    sums = [F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in ("applied", "failed", "pending")]
    return rows.agg(F.count(F.lit(1)).alias("intents"), F.count_if(F.col("n_pending").isNull()).alias("unexpanded"), *sums)


def state_counts(intents: DataFrame) -> DataFrame:
    return intents.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def rate_limit_episodes(events: DataFrame, keys: list[str]) -> DataFrame:
    """(seq, at, event: rate_limited, ended, response, status?, delay?) → an episode per run of limits: since, until, n.

    An end, or a response with a status of 200 to 299, closes an episode; other events leave it.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    ends = (F.col("event") == "ended") | ((F.col("event") == "response") & F.col("status").between(200, 299))
    marked = events.withColumn("__episode", F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    limits = marked.filter(F.col("event") == "rate_limited")
    return limits.groupBy(*keys, "__episode").agg(F.min_by("at", "seq").alias("since"), F.max(F.col("at") + F.coalesce("delay", F.lit(60))).alias("until"), F.count(F.lit(1)).alias("n")).drop("__episode")


def backoff(attempt: Column, retry_after: Column, base: int = 60, most: int = 600, doublings: int = 4) -> Column:
    """Seconds to pause after the attempt (from 0): doubling from ``base``, at least what the server asks, at most ``most``."""
    return F.least(F.lit(most), F.greatest(F.coalesce(retry_after, F.lit(0)), F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(doublings)))).cast("long"))


def retry_delay(attempt: Column, retry_after: Column, base: int = 30, most: int = 600) -> Column:
    """Seconds before the next try of one request: what the server asks and a doubling base on top, at most ``most``."""
    doubled = F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(30))).cast("long")
    return F.least(F.lit(most).cast("long"), F.coalesce(retry_after, F.lit(0)).cast("long") + doubled)


# Which state each operation asks for, and the event that it adds.
GUARDS = {"approve": (("awaiting_approval",), "approved"), "reject": (OPEN, "rejected"), "reinstate": (("rejected",), "reinstated")}


def _decided_in_turn(requests: DataFrame, intents: DataFrame) -> DataFrame:
    """Requests with ``__before``: the state that each meets, after all of the same intent's before it.

    What ended stays so.  Else a rejection leaves an intent rejected, allowed or not, and only a reinstatement gets it out of there, to where its approval
    stands anew.  So the state follows from which requests there were since the last rejection, and no request waits for another's row.
    """
    approval = F.col("requires_approval") if "requires_approval" in intents.columns else F.lit(False)
    held = intents.select("id", F.col("state").alias("__state"), approval.alias("__approval"), F.col("dismissed").alias("__was"))
    order = Window.partitionBy("id").orderBy("at", "op")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.join(held, "id", "left").withColumns({"__n": F.row_number().over(order), "__rejections": F.count_if(F.col("op") == "reject").over(before)})
    since = Window.partitionBy("id", "__rejections").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda op, which: which(F.when(F.col("op") == op, F.col("__n"))).over(since)
    rows = rows.withColumns({"__reopened": at("reinstate", F.min), "__approved": at("approve", F.max)})
    opened = F.when(~F.coalesce("__approval", F.lit(False)) | (F.col("__approved") > F.col("__reopened")), "ready").otherwise("awaiting_approval")
    was_rejected = (F.col("__rejections") > 0) | (F.col("__state") == "rejected")
    first = F.when((F.col("__state") == "awaiting_approval") & F.col("__approved").isNotNull(), "ready").otherwise(F.col("__state"))
    state = F.when(F.col("__state").isin("applied", "abandoned"), F.col("__state")).when(was_rejected, F.when(F.col("__reopened").isNull(), "rejected").otherwise(opened)).otherwise(first)
    return rows.withColumn("__before", F.when(F.col("__state").isNotNull(), state))


def guarded(requests: DataFrame, intents: DataFrame) -> DataFrame:
    """Requests (id, op: approve, reject, reinstate, at, dismiss?) against folded intents → id, at, op, event, dismiss, dismissed, error.

    Each request is judged by what the intent is after the requests before it (in the order of ``at``, then ``op``), so of two approvals in a batch one passes.
    ``event`` is what to add to the queue's log, null where the intent's state forbids it or there is none; ``dismissed`` is the
    entry for its subject: true when a rejection dismisses it, false when reinstating lifts that, else null.
    """
    rows = _decided_in_turn(requests, intents)
    allowed, event = F.lit(False), F.lit(None).cast("string")
    for op, (states, name) in GUARDS.items():
        allowed = F.when(F.col("op") == op, F.col("__before").isin(*states)).otherwise(allowed)
        event = F.when(F.col("op") == op, F.lit(name)).otherwise(event)
    dismiss = F.coalesce("dismiss", F.lit(False)) if "dismiss" in requests.columns else F.lit(False)
    rows = rows.withColumns({"__allowed": F.coalesce(allowed, F.lit(False)), "__dismiss": dismiss})
    rejected = F.col("__allowed") & (F.col("op") == "reject")
    # Whether the rejection that holds just now dismissed the subject: the last one that was allowed, or the log's.
    before = Window.partitionBy("id").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.last(F.when(rejected, F.col("__dismiss")), ignorenulls=True).over(before), F.col("__was"))
    rows = rows.withColumn("__held", was)
    entry = F.when(rejected & F.col("__dismiss"), True).when(F.col("__allowed") & (F.col("op") == "reinstate") & F.col("__held"), False)
    error = F.when(F.col("__before").isNull(), "not found").when(~F.col("__allowed"), F.concat(F.lit("can't "), F.col("op"), F.lit(" what is "), F.col("__before")))
    return rows.select("id", "at", "op", F.when(F.col("__allowed"), event).alias("event"), F.when(rejected, F.col("__dismiss")).alias("dismiss"), entry.alias("dismissed"), error.alias("error"))


def guarded_rules(requests: DataFrame, proposals: DataFrame) -> DataFrame:
    """Requests (id, op: approve, reject, at) against folded proposals of rules → id, at, event, joins (the rule becomes active), error.

    Only pending ones can be decided, so the first request of a proposal decides it for those after it.
    """
    order = Window.partitionBy("id").orderBy("at", "op")
    event = F.when(F.col("op") == "approve", "approved").otherwise("rejected")
    rows = requests.join(proposals.select("id", F.col("state").alias("__state")), "id", "left").withColumn("__event", event)
    decided = F.first("__event").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", F.when(F.col("__state") == "pending", F.coalesce(decided, F.lit("pending"))).otherwise(F.col("__state")))
    allowed = F.coalesce(F.col("__before") == "pending", F.lit(False))
    error = F.when(F.col("__before").isNull(), "not found").when(~allowed, F.concat(F.lit("is "), F.col("__before")))
    return rows.select("id", "at", F.when(allowed, F.col("__event")).alias("event"), (allowed & (F.col("op") == "approve")).alias("joins"), error.alias("error"))


def decide(dry_run: Column, needs_approval: Column, confirm: Column) -> Column:
    """What becomes of a suggestion: reported only, put up for approval, or ready."""
    return F.when(dry_run, "report").when(needs_approval | confirm, "awaiting_approval").otherwise("ready")


def activity(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(limit)
