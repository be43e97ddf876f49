"""Planning with several providers of suggestions: each looks at the plays that it hasn't seen, the first suggestion of a subject counts, failures stay apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from playlake.functions.rules import FIELDS, RewriteRule, apply_chain
from playlake.functions.texts import number_of
from playlake.operators import eventlog, interval, releases as catalogue
from playlake.operators.subjects import KEY, first_suggestions, group_by_subject, same_subject, without
from playlake.plans import planner

NEW = tuple(f"new_{f}" for f in FIELDS)
EVENTS = ("id", "seq", "at", "event", "provider", "requires_approval", "dismiss", *KEY, *NEW)


@dataclass(frozen=True)
class Provider:
    """A source of suggestions: ``suggest`` takes subjects (artist, track, album, album_artist, n, latest_uts) and returns those that it would change, with ``new_<field>`` and ``confirm`` added."""

    name: str
    suggest: Callable[[DataFrame], DataFrame]


def by_rules(rules: Sequence[RewriteRule], name: str = "rules") -> Provider:
    """Rewrite rules, one after another."""
    return Provider(name, lambda subjects: apply_chain(subjects, list(rules)).filter("changed"))


def by_catalogue(matches: DataFrame, name: str = "catalogue") -> Provider:
    """Names as a catalogue has them; ``matches`` has one row (artist, track, m_artist, m_title, m_album) at most for a track."""
    def suggest(subjects: DataFrame) -> DataFrame:
        told = subjects.withColumn("id", F.xxhash64(*KEY)).withColumn("id", F.concat_ws("/", F.col("id").cast("string"), F.to_json(F.struct(*KEY))))
        found = told.select("id", "artist", F.col("track").alias("name"), "album").join(matches.withColumnRenamed("track", "name"), ["artist", "name"])
        fixed = catalogue.corrections(found.select("id", "artist", "name", "album"), found.select("id", "m_artist", "m_title", "m_album")).filter("kind = 'edit'").drop("kind")
        album = F.when(F.col("album").isNull() & (F.col("new_album") == ""), None).otherwise(F.col("new_album"))
        return told.join(fixed, "id").drop("id").withColumns({"new_album": album, "new_album_artist": F.col("album_artist")})

    return Provider(name, suggest)


def off_compilations(releases: DataFrame, name: str = "compilations") -> Provider:
    """Moves from compilations to the releases that tracks come from; ``releases`` has a subject's artist, track and album, and what the ranking of releases reads."""
    def suggest(subjects: DataFrame) -> DataFrame:
        keys = ["artist", "track", "album"]
        held = releases.join(subjects.filter(F.col("album").isNotNull()).select(*keys).distinct(), keys, "left_semi")
        moved = catalogue.off_compilations(held, keys, "album")
        return subjects.join(moved, keys).withColumns({"new_artist": F.col("artist"), "new_track": F.col("track"), "new_album_artist": F.col("album_artist")})

    return Provider(name, suggest)


@dataclass
class Pass:
    """What a pass came to: intents (a row per subject with its provider and outcome), events for the queue, coverage (provider, start, end, verified_at) afterwards, failures by provider."""

    intents: DataFrame
    events: DataFrame
    coverage: DataFrame
    failed: dict[str, str] = field(default_factory=dict)


def occupied(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects of open intents, and dismissed ones."""
    folded = eventlog.fold_queue(queue).join(queue.filter("event = 'created'").select("id", *KEY), "id")
    return folded.filter(F.col("state").isin(*eventlog.OPEN)).select(*KEY), folded.filter("dismissed").select(*KEY)


def plan_with(
    plays: DataFrame, providers: Sequence[Provider], synced: DataFrame, coverage: DataFrame, queue: DataFrame, start: int, end: int, now: int,
    folder: str, dry_run: bool = False, needs_approval: bool = False,
) -> Pass:
    """A pass of all providers over the plays within the synced ranges that each hasn't seen.

    Each provider's suggestions are written below ``folder`` before the next one is asked.  One that raises, in its plan or in a task, is left out of
    this pass: its claim is withheld, so that it sees the same plays in the next one; the others' suggestions and claims stand.  Of a subject the first provider's
    suggestion counts, in the order given; all providers look at a subject, so an earlier one's failure lets a later one's suggestion through.
    """
    spark = plays.sparkSession
    window = interval.clip(synced, start, end)
    busy, dismissed = occupied(queue)
    written, claims, failed = [], [], {}
    for rank, provider in enumerate(providers):
        own = coverage.filter(F.col("provider") == provider.name).select("start", "end", "verified_at")
        work = interval.subtract(window, own).withColumn("verified_at", F.lit(now).cast("long"))
        try:
            subjects = without(group_by_subject(interval.contains(plays, work, [])), dismissed, busy)
            found = provider.suggest(subjects).select(*KEY, "n", "latest_uts", *NEW, "confirm")
            found.withColumns({"provider": F.lit(provider.name), "provider_rank": F.lit(rank), "idx": F.lit(0), "kind": F.lit("edit")}).write.mode("overwrite").parquet(f"{folder}/{rank}")
        except Exception as error:  # whatever a provider does wrong is its own failure, not the pass's
            failed[provider.name] = f"{type(error).__name__}: {error}".split("\n")[0]
            continue
        written.append(spark.read.parquet(f"{folder}/{rank}"))
        claims.append(work.withColumn("provider", F.lit(provider.name)))
    intents = _intents(spark, written, dry_run, needs_approval)
    events = intents.filter("outcome <> 'report'").select(
        number_of(F.lit(now), F.to_json(F.struct(*KEY, *NEW))).alias("id"), F.lit(now).cast("long").alias("seq"), F.lit(now).cast("long").alias("at"), F.lit("created").alias("event"), "provider",
        (F.col("outcome") == "awaiting_approval").alias("requires_approval"), F.lit(False).alias("dismiss"), *KEY, *NEW,
    )
    after = coverage
    for claim in claims:
        after = planner.claimed(after, claim, dry_run=dry_run)
    return Pass(intents, events, after, failed)


def _intents(spark, written: list[DataFrame], dry_run: bool, needs_approval: bool) -> DataFrame:
    columns = ", ".join([*(f"{k} string" for k in KEY), "n long, latest_uts long", *(f"{c} string" for c in NEW), "confirm boolean, provider string, provider_rank int, idx int, kind string"])
    both = spark.createDataFrame([], columns)
    for found in written:
        both = both.unionByName(found)
    chosen = first_suggestions(both)
    outcome = eventlog.decide(F.lit(dry_run), F.lit(needs_approval), F.col("confirm"))
    return chosen.select(*KEY, "n", "latest_uts", *NEW, "confirm", "provider", outcome.alias("outcome"))


def reported(suggestions: DataFrame, intents: DataFrame) -> DataFrame:
    """Suggestions that another provider's came before."""
    chosen = intents.select(*KEY, F.col("provider").alias("chosen"))
    return suggestions.join(chosen, same_subject(suggestions, chosen)).filter("provider <> chosen").select(*[suggestions[k] for k in KEY], "provider", "chosen")
