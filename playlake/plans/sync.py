"""Syncing with a paged upstream: which page rows are new, and how far a pass confirms that a range is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playlake.operators import interval, store

MARGIN = 60


def confirmed(pages: DataFrame, start: int, keys: list[str] = ()) -> DataFrame:
    """Per page of a newest-first pass (page_number, oldest, total_pages; ``to`` is where it began): the claim that it allows.

    A page that reaches behind ``start``, or the last one, confirms all down to ``start``; any other only down to the second
    after its oldest row, as that second may go on on the next page.
    """
    order = Window.partitionBy(*keys).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    low = F.min("oldest").over(order)
    complete = F.max((F.col("oldest") < start) | (F.col("page_number") >= F.col("total_pages"))).over(order)
    claim_start = F.when(complete, F.lit(start).cast("long")).otherwise(low + 1)
    return pages.select(*keys, "page_number", claim_start.alias("claim_start"), F.col("to").alias("claim_end"), complete.alias("complete")).filter("claim_start < claim_end")


def pass_rows(pages: DataFrame, start: int) -> DataFrame:
    """The rows of a newest-first pass that it reads: pages up to the first that reaches behind ``start``, or to the last there is.

    ``pages``: observations with page_number and total_pages.  A page's place in the pass needs the pages before it only as
    one number each, so nothing but these numbers is ordered.
    """
    facts = pages.groupBy("page_number").agg(F.min("uts").alias("oldest"), F.max("total_pages").alias("total_pages"))
    before = Window.orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)  # one row a page
    done = F.coalesce(F.max((F.col("oldest") < start) | (F.col("page_number") >= F.col("total_pages"))).over(before), F.lit(False))
    read = facts.withColumn("__done", done).filter(~F.col("__done")).select("page_number")
    return pages.join(read, "page_number", "left_semi")


def sync_pass(pages: DataFrame, log: DataFrame, coverage: DataFrame, start: int, now: int) -> tuple[DataFrame, DataFrame]:
    """A pass from the pin ``now - MARGIN`` down to ``start``: (rows to append, coverage afterwards).

    ``pages`` are the service's pages as one table, as :func:`playlake.sources.pages.api_tracks` makes it: observations with
    page_number and total_pages, the newest first.
    """
    to = now - MARGIN
    if to <= start:
        return log.limit(0), coverage
    read = pass_rows(pages, start)
    facts = read.groupBy("page_number").agg(F.min("uts").alias("oldest"), F.max("total_pages").alias("total_pages")).withColumn("to", F.lit(to).cast("long"))
    claim = confirmed(facts, start).select(F.col("claim_start").alias("start"), F.col("claim_end").alias("end"), F.lit(now).cast("long").alias("verified_at"))
    rows = read.filter((F.col("uts") >= start) & (F.col("uts") < to)).drop("page_number", "total_pages")
    fresh = store.classify_append(log, rows).filter("outcome <> 'unchanged'").drop("outcome")
    return fresh, interval.union(coverage, claim)


def sync_report(pages: DataFrame, log: DataFrame, coverage: DataFrame, start: int, now: int) -> DataFrame:
    """One row of a pass: pages, new, updated and unchanged rows, seconds newly covered."""
    to = now - MARGIN
    read = pass_rows(pages, start)
    rows = read.filter((F.col("uts") >= start) & (F.col("uts") < to)).drop("page_number", "total_pages")
    _, after = sync_pass(pages, log, coverage, start, now)
    more = interval.subtract(after, coverage).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("seconds_covered"))
    return read.agg(F.count_distinct("page_number").alias("pages")).crossJoin(store.append_stats(log, rows)).crossJoin(more)  # one row each


def extend_window(coverage: DataFrame, history_start: int | None, now: int) -> DataFrame:
    """What extending to the present has to fetch: from the end of coverage, or from where history starts, to the pin; no row if that is reached."""
    last = coverage.agg(F.coalesce(F.max("end"), F.lit(history_start or 0)).cast("long").alias("start"))
    return last.withColumn("end", F.lit(now - MARGIN).cast("long")).filter("start < end")


def fill_order(coverage: DataFrame, start: int, end: int) -> DataFrame:
    """The gaps within a range in the order in which they are filled: the newest first (``place`` from 0)."""
    gaps = interval.gaps(coverage, start, end)
    return gaps.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("end"))) - 1).cast("long"))  # a person's gaps are few


def invalidate(coverage: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(coverage without a range, what that changes): whatever was there must be fetched anew."""
    hole = coverage.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    return interval.subtract(coverage, hole), interval.subtract_changes(coverage, hole)


def history_start(plays: DataFrame, known: int | None, window_start: int, complete: bool) -> DataFrame:
    """Where history begins, if a complete pass from the very beginning has shown it and it wasn't known: one row at most."""
    found = plays.agg(F.min("uts").alias("history_start")).filter("history_start is not null")
    return found if complete and window_start == 0 and known is None else found.limit(0)


def next_gap(coverage: DataFrame, start: int, end: int) -> DataFrame:
    """The newest gap, which a backfill takes first."""
    return interval.gaps(coverage, start, end).orderBy(F.desc("end")).limit(1)
