"""Planning of a clean-up: which plays to look at, what each subject becomes, what is claimed as looked at."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from playlake.folders import new_folder
from playlake.functions.rules import FIELDS, RewriteRule, apply_chain
from playlake.operators import interval
from playlake.operators.eventlog import decide
from playlake.operators.subjects import KEY, group_by_subject, without
from playlake.plans.tiling import tiles


def _closing(keys: list[str], start: int, end: int, hint: int):
    """Seconds of keys, in order, → their batches; only the open batch is remembered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, state = [*keys, "batch", "claim_start", "claim_end", "n"], None, None
        schema = None
        for batch in batches:
            schema = schema or [batch.schema.field(k).type for k in keys]
            out: list[tuple] = []
            for *own, uts, n in zip(*(batch.column(c).to_pylist() for c in (*keys, "uts", "n")), strict=True):
                if state is None or own != key:
                    if state is not None:
                        out.append((*key, state[0], state[1], end, state[2]))
                    key, state = own, [0, start, 0]
                if state[2] >= hint:
                    out.append((*key, state[0], state[1], state[3], state[2]))
                    state = [state[0] + 1, state[3], 0]
                state[2:] = [state[2] + n, uts + 1]
            yield _batch(out, names, schema)
        if state is not None:
            yield _batch([(*key, state[0], state[1], end, state[2])], names, schema)

    def _batch(rows, names, schema):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate([*schema, *[pa.int64()] * 4])], names)

    return run


def claims(plays: DataFrame, start: int, end: int, hint: int, keys: list[str] = ()) -> DataFrame:
    """Batches of plays with claims that tile [start, end): (keys, batch, claim_start, claim_end, n).

    A batch ends behind the first second that brings it to ``hint`` plays, so no second is split; the last one ends with
    the range.  The choice is greedy, so each key's seconds, counted beforehand, are dealt to one task and sorted there (on disk if
    need be), and a task remembers no more than the open batch.  Without keys the counted seconds are written, and spans of time are
    cut side by side (:mod:`playlake.plans.tiling`); there is always a last batch.
    """
    keys = list(keys)
    seconds = plays.filter((F.col("uts") >= start) & (F.col("uts") < end)).groupBy(*keys, "uts").agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        spark, folder = plays.sparkSession, new_folder(plays.sparkSession, "seconds")
        seconds.write.parquet(folder)
        return tiles(spark.read.schema("uts long, n long").parquet(folder), start, end, hint)
    dealt = seconds.repartition(*keys)
    kinds = [f"`{k}` {dict(plays.dtypes)[k]}" for k in keys]
    ordered = dealt.sortWithinPartitions(*keys, F.col("uts").asc_nulls_first()).select(*keys, F.col("uts").cast("long"), F.col("n").cast("long"))
    return ordered.mapInArrow(_closing(keys, start, end, hint), ", ".join([*kinds, "batch long, claim_start long, claim_end long, n long"]))


def chunks(plays: DataFrame, hint: int, keys: list[str]) -> DataFrame:
    """Plays with the number of their batch of ``hint``, within each key, without claims."""
    order = Window.partitionBy(*keys).orderBy("uts", "id")
    return plays.withColumn("batch", F.floor((F.row_number().over(order) - 1) / hint))


def feed(plays: DataFrame, synced: DataFrame, coverage: DataFrame, start: int, end: int) -> DataFrame:
    """The plays that lie in work that some provider has to do."""
    work = interval.incremental_work(synced, coverage, start, end)
    return interval.contains(plays, work.withColumn("verified_at", F.lit(0).cast("long")), [])


def plan(plays: DataFrame, rules: list[RewriteRule], dismissed: DataFrame, open_subjects: DataFrame, dry_run: bool = False, needs_approval: bool = False, catalogue_ok=None) -> DataFrame:
    """Plays → intents: one row per subject that a rule changes, with its new values and what becomes of it.

    Plays are grouped to subjects before any rule runs, so the cost follows the number of different subjects.
    """
    subjects = without(group_by_subject(plays), dismissed, open_subjects)
    changed = apply_chain(subjects, rules, catalogue_ok).filter("changed")
    outcome = decide(F.lit(dry_run), F.lit(needs_approval), F.col("confirm"))
    return changed.select(*KEY, "n", "latest_uts", *[f"new_{f}" for f in FIELDS], "confirm", outcome.alias("outcome"))


def plan_report(subjects: DataFrame, intents: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """One row of a planning pass: subjects seen, suggestions, those queued ready, those awaiting approval, those reported only, rules proposed."""
    seen = subjects.agg(F.count(F.lit(1)).alias("subjects_seen"))
    told = {"queued_ready": "ready", "queued_awaiting_approval": "awaiting_approval", "reported_only": "report"}
    counts = intents.agg(F.count(F.lit(1)).alias("suggestions"), *[F.count_if(F.col("outcome") == o).alias(n) for n, o in told.items()])
    rules = proposed.agg(F.count(F.lit(1)).alias("rules_proposed")) if proposed is not None else intents.sparkSession.range(1).select(F.lit(0).cast("long").alias("rules_proposed"))
    return seen.crossJoin(counts).crossJoin(rules)  # one row each


def execution_report(outcomes: DataFrame, instances: DataFrame) -> DataFrame:
    """One row of an execution pass: intents processed, completed, abandoned (id, outcome); instances applied, failed (status)."""
    intents = outcomes.agg(F.count(F.lit(1)).alias("intents_processed"), *[F.count_if(F.col("outcome") == o).alias(f"intents_{o}") for o in ("completed", "abandoned")])
    return intents.crossJoin(instances.agg(*[F.count_if(F.col("status") == s).alias(f"instances_{s}") for s in ("applied", "failed")]))  # one row each


def report(intents: DataFrame) -> DataFrame:
    """How many subjects and plays by outcome."""
    return intents.groupBy("outcome").agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("plays"))


def claimed(coverage: DataFrame, claim: DataFrame, failed_providers: list[str] = (), dry_run: bool = False) -> DataFrame:
    """Coverage (provider, start, end, verified_at) after a pass; providers that failed, and dry runs, claim nothing."""
    if dry_run:
        return coverage
    new = claim.filter(~F.col("provider").isin(list(failed_providers))) if failed_providers else claim
    return interval.normalise(coverage.unionByName(new), ["provider"])


def reset_coverage(coverage: DataFrame, known_hash: str | None, rules_hash: str, provider: str = "rules") -> DataFrame:
    """Coverage without that of the rules, if those have changed."""
    return coverage if known_hash == rules_hash else coverage.filter(F.col("provider") != provider)
