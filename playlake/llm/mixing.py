"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each document has a pseudo-random 60-bit hash of its id.  Words are summed by source and hash bucket; the running sum
shows in which bucket a source's budget ends.  Only that boundary bucket is looked at again, with finer buckets, and at
last by single hashes, so that every source gets one threshold.  A document is taken when its hash lies below it: no
sort, no state per document, and a larger budget takes a superset of a smaller one's documents.

Targets share ``epochs`` times all words among the sources by weight.  A target stops at ``max_repeat`` times its
source's words; what it can't use goes to the others by weight until none is above.  A source with a target of k times
its words and a remainder takes each document k times, and the documents below the threshold once more.

Defined results: a null text has no words; a null source is a source like another, in the last place; documents with
equal ids (null ids among them) have the same hash and are taken or left together; a source without words has the
target 0; an empty table gives an empty result.  Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playlake.llm.scratch import Scope, materialize

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MAX_REPEAT = 2
HASH_BITS, BUCKET_BITS = 60, 12


def n_words(text):
    """Maximal runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def id_hash(doc_id):
    """60 bits of the MD5 of the id's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) → the same with ``target``.

    Sources that reach their cap are those with the least cap for their weight; in that order the level of the others
    follows from running sums, so the resharing needs no loop.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select(
        "source", "source_size", "place",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)) + 1).alias("weight"),
        (F.col("source_size") * max_repeat).cast("double").alias("cap"),
    )
    upto = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "place")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * epochs - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    # The first source that stays below its cap sets the level of all that follow.
    level = level.withColumn("common", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return level.select("source", "source_size", F.coalesce(F.col("common") * F.col("weight"), F.col("cap")).alias("target"))


def _boundary(sums: DataFrame, budgets: DataFrame, bucket: str) -> DataFrame:
    """(source, bucket, words) and (source, budget) → each source's first bucket that goes over what is left, and what is left before it."""
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(bucket)))
    over = running.join(budgets, running["source"].eqNullSafe(budgets["b_source"])).filter(F.col("upto") > F.col("budget"))
    first = over.groupBy("source").agg(F.min(F.struct(bucket, (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))).alias("at"))
    return first.select(F.col("source").alias("b_source"), F.col(f"at.{bucket}").alias("edge"), F.col("at.left").alias("budget"))


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """slim (source, size, hash), budgets (b_source, budget) → b_source, threshold: take hashes below it.

    Sources whose words don't exceed their budget aren't in the result.
    """
    spark, left = slim.sparkSession, budgets
    for level in (1, 2):
        shift = HASH_BITS - level * BUCKET_BITS
        rows = slim.withColumn("bucket", F.shiftright("hash", shift))
        if level > 1:
            rows = rows.join(left.withColumnRenamed("edge", "b_edge"), rows["source"].eqNullSafe(F.col("b_source")) & (F.shiftright("bucket", BUCKET_BITS) == F.col("b_edge")), "left_semi")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        left = materialize(_boundary(sums, left.select("b_source", "budget"), "bucket"), "edges")
    shift = HASH_BITS - 2 * BUCKET_BITS
    rows = slim.join(left.withColumnRenamed("edge", "b_edge"), slim["source"].eqNullSafe(F.col("b_source")) & (F.shiftright("hash", shift) == F.col("b_edge")), "left_semi")
    last = materialize(_boundary(rows.groupBy("source", "hash").agg(F.sum("size").alias("words")), left.select("b_source", "budget"), "hash"), "edges")
    at = rows.groupBy("source", "hash").agg(F.sum("size").alias("words")).join(last, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("hash") == F.col("edge")))
    # The document on the edge is taken if that comes nearer to the budget.
    return at.select("b_source", (F.col("edge") + F.when(F.col("words") - F.col("budget") < F.col("budget"), 1).otherwise(0)).alias("threshold"))


def _copies(max_repeat: int):
    """How often a document is taken, from its hash and its source's plan.  Only documents without words could be taken more often than allowed: those below the edge of an empty budget."""
    return F.least(F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0), F.lit(max_repeat)).cast("long")


def plan_sources(slim: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """slim (source, size, hash) → one row per source: t_source, source_size, target, whole (copies of all), threshold (hashes below it once more)."""
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, max_repeat), "targets")
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    budgets = targets.filter("source_size > 0").select(F.col("source").alias("b_source"), rest.alias("budget"))
    edges = thresholds(slim, budgets)
    plan = targets.join(edges, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
        F.col("source").alias("t_source"), "source_size", "target", "threshold",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    )
    return materialize(plan, "plan")


def _slim(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, hash of all documents, without their texts."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash")), "sizes")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted), copies."""
    with Scope(docs.sparkSession) as scope:
        slim = scope.keep(_slim(docs, text_col, id_col, source_col))
        plan = scope.keep(plan_sources(slim.select("source", "size", "hash"), weights, epochs, max_repeat))
    rows = slim.join(plan, slim["source"].eqNullSafe(plan["t_source"])).withColumn("copies", _copies(max_repeat))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as it is taken.  Texts aren't written: each row meets its source's plan as it is read."""
    with Scope(docs.sparkSession) as scope:
        plan = scope.keep(plan_sources(_slim(docs, text_col, id_col, source_col).select("source", "size", "hash"), weights, epochs, max_repeat))
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), id_hash(F.col(id_col)).alias("hash"))
    repeated = named.join(plan, named["source"].eqNullSafe(plan["t_source"])).select("row", F.explode(F.array_repeat(F.lit(0), _copies(max_repeat).cast("int"))))
    return repeated.select("row.*")
