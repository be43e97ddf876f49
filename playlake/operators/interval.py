"""Algebra of half-open ranges, each key's by itself: normalise, unite, intersect, subtract, gaps, changes.

All functions take ``keys``, the columns that tell one map of ranges from another; windows are partitioned by them, so
many maps are worked on in parallel, and one map is as small as the ranges that a person's history is cut into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def normalise(ranges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Ranges that overlap or touch become one, verified when its oldest part was; empty ones go."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    islands = ranges.filter("start < end").withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("verified_at").alias("verified_at")).drop("__island")


def union(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    return normalise(left.unionByName(right), keys)


def _sweep(left: DataFrame, right: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Where ``inside``, a condition on the numbers ``a`` and ``b`` of open ranges of each side, holds."""
    edges = None
    for side, (da, db) in ((left, (1, 0)), (right, (0, 1))):
        side = side.filter("start < end")
        for at, sign in (("start", 1), ("end", -1)):
            part = side.select(*keys, F.col(at).alias("t"), F.lit(sign * da).alias("da"), F.lit(sign * db).alias("db"))
            edges = part if edges is None else edges.unionByName(part)
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    points = edges.groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    points = points.select(*keys, "t", F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"), F.lead("t").over(order).alias("next"))
    pieces = points.filter(inside & F.col("next").isNotNull()).select(*keys, F.col("t").alias("start"), F.col("next").alias("end"), F.lit(0).cast("long").alias("verified_at"))
    return normalise(pieces, keys).drop("verified_at")


def intersect(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    return _sweep(left, right, list(keys), (F.col("a") > 0) & (F.col("b") > 0))


def _pieces(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of each range of a normalised map: keys, of (the range's start), start, end, verified_at."""
    held = left.filter("start < end").select(*keys, F.col("start").alias("t"), "end", "verified_at")
    # At most one range of the left side is open at a time, so running sums carry its start and time along.
    edges = held.select(*keys, "t", F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("t").alias("of"), "verified_at")
    edges = edges.unionByName(held.select(*keys, F.col("end").alias("t"), F.lit(-1).alias("a"), F.lit(0).alias("b"), (-F.col("t")).alias("of"), (-F.col("verified_at")).alias("verified_at")))
    for at, sign in (("start", 1), ("end", -1)):
        edges = edges.unionByName(right.filter("start < end").select(*keys, F.col(at).alias("t"), F.lit(0).alias("a"), F.lit(sign).alias("b"), F.lit(0).cast("long").alias("of"), F.lit(0).cast("long").alias("verified_at")))
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    points = edges.groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in ("a", "b", "of", "verified_at")])
    points = points.select(*keys, "t", *[F.sum(c).over(upto).alias(c) for c in ("a", "b", "of", "verified_at")], F.lead("t").over(order).alias("next"))
    free = points.filter((F.col("a") > 0) & (F.col("b") == 0) & F.col("next").isNotNull())
    # Stretches that touch belong together: only other removed ranges' edges lie between them.
    new = F.when(F.lag("next").over(Window.partitionBy(*keys, "of").orderBy("t")) == F.col("t"), 0).otherwise(1)
    run = F.sum("__new").over(Window.partitionBy(*keys, "of").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    runs = free.withColumn("__new", new).withColumn("__run", run)
    return runs.groupBy(*keys, "of", "__run").agg(F.min("t").alias("start"), F.max("next").alias("end"), F.max("verified_at").alias("verified_at")).drop("__run")


def subtract(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The left map's ranges without the right's; each piece keeps when its range was verified, if the left side says that."""
    timed = "verified_at" in left.columns
    held = left if timed else left.withColumn("verified_at", F.lit(0).cast("long"))
    out = _pieces(normalise(held, keys), right, list(keys)).drop("of")
    return out if timed else out.drop("verified_at")


def gaps(ranges: DataFrame, start: int, end: int, keys: list[str] = ()) -> DataFrame:
    """What is missing within [start, end), for each key that has any range."""
    whole = ranges.select(*keys).distinct() if keys else ranges.sparkSession.range(1)
    whole = whole.select(*keys, F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    return subtract(whole, ranges, keys)


def contains(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "uts", span: int = 86400 * 31) -> DataFrame:
    """The points that lie in a range of their key.

    Points and ranges meet by key and period of ``span`` seconds, an equi-join, and not each with each.
    """
    slots = normalise(ranges, keys).withColumn("__slot", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))))
    placed = points.withColumn("__slot", F.floor(F.col(at) / span))
    on = [placed[k].eqNullSafe(slots[k]) for k in keys] + [placed["__slot"] == slots["__slot"], placed[at] >= slots["start"], placed[at] < slots["end"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return placed.join(slots, cond, "left_semi").drop("__slot")


def clip(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges as far as they lie in [start, end)."""
    clipped = ranges.select(F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "verified_at")
    return clipped.filter("start < end")


def covers(ranges: DataFrame, start: int, end: int, keys: list[str] = ()) -> DataFrame:
    """Whether a single range holds all of [start, end); an empty one is held by anything."""
    held = (F.lit(start) >= F.lit(end)) | ((F.col("start") <= start) & (F.col("end") >= end))
    return normalise(ranges, keys).groupBy(*keys).agg(F.max(held).alias("covered"))


def total(ranges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Covered seconds, first start, last end, number of ranges."""
    return normalise(ranges, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count(F.lit(1)).alias("segments"))


def insert_changes(held: DataFrame, added: DataFrame, keys: list[str] = ()) -> DataFrame:
    """What adding ranges does to a normalised map: (kind, start, end, absorbed) for created, extended, merged; nothing for ranges that change nothing."""
    sides = held.withColumn("__old", F.lit(1)).unionByName(added.withColumn("__old", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = sides.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    old = F.col("__old") == 1
    merged = islands.groupBy(*keys, "__island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("verified_at").alias("verified_at"), F.count_if(old).alias("absorbed"), F.count_if(~old).alias("__added"),
        F.min(F.when(old, F.struct("start", "end", "verified_at"))).alias("__held"),
    )
    same = (F.col("absorbed") == 1) & (F.col("__held") == F.struct("start", "end", "verified_at"))
    kind = F.when(F.col("absorbed") == 0, "created").when(F.col("absorbed") == 1, "extended").otherwise("merged")
    return merged.filter((F.col("__added") > 0) & ~same).select(*keys, kind.alias("kind"), "start", "end", "absorbed")


def subtract_changes(held: DataFrame, removed: DataFrame, keys: list[str] = ()) -> DataFrame:
    """What taking ranges away does to each range of a normalised map: (kind, start, end, pieces) for split, shrunk, removed."""
    left = _pieces(held, removed, list(keys)).select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("of").alias("l_of"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    cond = F.col("l_of") == F.col("start")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"l_{k}"))
    pieces = held.join(left, cond, "left").groupBy(*keys, "start", "end").agg(F.count("l_start").alias("pieces"), F.coalesce(F.sum(F.col("l_end") - F.col("l_start")), F.lit(0)).alias("__left"))
    kind = F.when(F.col("pieces") == 0, "removed").when(F.col("pieces") > 1, "split").otherwise("shrunk")
    return pieces.filter(F.col("__left") < F.col("end") - F.col("start")).select(*keys, kind.alias("kind"), "start", "end", "pieces")


def incremental_work(synced: DataFrame, coverage: DataFrame, start: int, end: int, provider: str = "provider") -> DataFrame:
    """What any provider still has to see: the union over providers of (synced within the window) minus its coverage.

    That is the window less what all providers have covered, which one sweep over their merged ranges finds; without providers there is no work.
    """
    window = synced.select(F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end")).filter("start < end")
    n = coverage.select(provider).distinct().count()
    if not n:
        return window.limit(0)
    merged = normalise(coverage.select(provider, "start", "end", F.lit(0).cast("long").alias("verified_at")), [provider])
    steps = merged.select(F.col("start").alias("at"), F.lit(1).alias("by")).unionByName(merged.select(F.col("end").alias("at"), F.lit(-1).alias("by"))).groupBy("at").agg(F.sum("by").alias("by"))
    order = Window.orderBy("at")  # ranges that are merged where they touch
    covered = steps.withColumns({"n": F.sum("by").over(order), "until": F.lead("at").over(order)}).filter(F.col("n") == n)
    work = subtract(window, covered.select(F.col("at").alias("start"), F.col("until").alias("end")))
    return normalise(work.select("start", "end", F.lit(0).cast("long").alias("verified_at"))).drop("verified_at")
