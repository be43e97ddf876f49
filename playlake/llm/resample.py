"""Importance resampling towards a target corpus: hashed n-gram features, gains by bucket, Gumbel top-k.

A feature is a run of words, hashed into one of ``buckets`` buckets.  Each task packs the documents that it reads into blocks, and writes a block's
inverted postings: for every bucket that occurs in it one row with the documents' places and counts, so what is shuffled is already counted, and no
row grows beyond a block.  The postings of both corpora are grouped by bucket, where the bucket's gain follows from the two sums; each block's
postings of the bucket get it by (bucket, block), so that a bucket which every document holds is dealt out by blocks.  A posting's
contribution is its count times the gain.  They are added up within tasks by block, then by document.

The draw adds to each document's mean gain a Gumbel deviate that is a function of seed and id, so the highest scores are a sample
without replacement, the same in every run.  Scores are sorted by range; a document's rank is its place in its range and what ranges before hold.

Defined results: a null text has no words, and weight 0; rows that repeat an id are documents of their own with the same deviate; a null id has the deviate of the
empty string and comes last among ties; ties of score and id go to fewer features, and then it doesn't matter; an empty target has no features, an empty
table gives an empty one; other columns aren't read.  Texts are split piece by piece, so that a long one costs its distinct words only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.llm.scratch import Scope, materialize
from playlake.llm.worker import bound_batches

#: Documents and postings of a block, at which it is written.
BLOCK_DOCS, BLOCK_POSTINGS, PIECE = 4096, 1 << 20, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_POSTINGS = "block long, bucket int, n long, places binary, counts binary, ids array<bigint>, n_features array<bigint>"


def words(text: str) -> Iterator[list[bytes]]:
    """Letters and digits in a row, A-Z in lower case, some hundred thousand at a time; all that isn't ASCII belongs to words."""
    raw = text.encode().translate(_LOWER)
    at = 0
    while at < len(raw):
        end = at + PIECE
        end = len(raw) if end >= len(raw) else raw.find(b" ", end) % (len(raw) + 1)
        yield raw[at:end].split()
        at = end


def features(text: str, runs: int) -> Iterator[list[bytes]]:
    """All runs of one to ``runs`` words."""
    before: list[bytes] = []
    for part in words(text):
        yield part
        both = before + part
        for n in range(2, runs + 1):
            first = max(0, len(before) - n + 1)
            yield [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
        before = both[len(both) - runs + 1 :] if runs > 1 else []


def _inverting(buckets: int, runs: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n_found = 0

        def flush() -> tuple[pa.RecordBatch, pa.RecordBatch]:
            place = np.repeat(np.arange(len(found), dtype=np.uint16), [len(b) for b, _ in found])
            bucket, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(bucket, kind="stable")
            bucket, place, count = bucket[order], place[order], count[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]))  # none without postings
            # A count that doesn't fit into 16 bits makes its whole list wider.
            packed = [c.astype("<u2" if c.max() < 1 << 16 else "<u8").tobytes() for c in (count[a:b] for a, b in cuts)]
            n = np.add.reduceat(count, starts) if len(count) else np.zeros(0, np.int64)
            rows = len(cuts)
            head = pa.RecordBatch.from_pydict({"block": [block], "bucket": pa.array([None], pa.int32()), "n": [sum(sizes)], "places": pa.nulls(1, pa.binary()), "counts": pa.nulls(1, pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64())), "n_features": pa.array([sizes], pa.list_(pa.int64()))})
            lists = pa.RecordBatch.from_pydict({"block": pa.array([block] * rows, pa.int64()), "bucket": pa.array(bucket[starts], pa.int32()), "n": pa.array(n, pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array(packed, pa.binary()), "ids": pa.nulls(rows, pa.list_(pa.int64())), "n_features": pa.nulls(rows, pa.list_(pa.int64()))})
            return head, lists

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counted: Counter[bytes] = Counter()
                total: Counter[int] = Counter()
                for part in features(text.as_py() or "", runs):
                    counted.update(part)
                    if len(counted) > PIECE:
                        _fold(counted, total, buckets)
                n = sum(counted.values()) + sum(total.values())
                _fold(counted, total, buckets)
                ids.append(doc_id)
                sizes.append(n)
                found.append((np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))))
                n_found += len(total)
                if len(ids) >= block_docs or n_found >= BLOCK_POSTINGS:
                    yield from flush()
                    block, ids, sizes, found, n_found = block + 1, [], [], [], 0
        if ids:
            yield from flush()

    return run


def _fold(counted: Counter, total: Counter, buckets: int) -> None:
    """Add counts of features to those of their buckets."""
    crc = zlib.crc32
    for feature, n in counted.items():
        total[crc(feature) % buckets] += n
    counted.clear()


def _contributing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block: the sum of counts times gains of each document that a task meets, one row per block."""
    block, sums = None, np.zeros(BLOCK_DOCS, np.int64)
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sums", pa.binary())])

    def flush() -> pa.RecordBatch:
        touched = np.flatnonzero(sums)
        out = sums[touched]
        sums[:] = 0
        return pa.RecordBatch.from_pydict({"block": [block], "places": [touched.astype("<u2").tobytes()], "sums": [_narrow(out)]}, schema)

    for batch in batches:
        for b, gain, n_places, raw in zip(batch.column("block").to_pylist(), batch.column("gain").to_pylist(), batch.column("places").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    yield flush()
                block = b
            places = np.frombuffer(n_places, "<u2")
            sums[places] += gain * np.frombuffer(raw, "<u2" if len(raw) == 2 * len(places) else "<u8").astype(np.int64)
    if block is not None:
        yield flush()


def _narrow(values: np.ndarray) -> bytes:
    fits = not len(values) or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
    return values.astype("<i4" if fits else "<i8").tobytes()


def _reducing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block: its documents with the sums of their contributions."""
    block, sums, ids, sizes = None, np.zeros(BLOCK_DOCS, np.int64), None, None
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def flush() -> pa.RecordBatch:
        n = np.array(sizes, np.int64)
        weight = np.where(n > 0, sums[: len(n)] // np.maximum(n, 1), 0)  # floors go down
        sums[:] = 0
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(weight)], schema=schema)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "sums", "ids", "n_features")), strict=True):
            if row[0] != block:
                if block is not None:
                    yield flush()
                block = row[0]
            if row[3] is not None:
                ids, sizes = row[3], row[4]
            else:
                places = np.frombuffer(row[1], "<u2")
                sums[places] += np.frombuffer(row[2], "<i4" if len(row[2]) == 4 * len(places) else "<i8").astype(np.int64)
    if block is not None:
        yield flush()


def postings(docs: DataFrame, runs: int = 1, buckets: int = 10_000, text_col: str = "text", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Inverted postings in blocks of at most :data:`BLOCK_DOCS` documents, and one row (``bucket`` null) per block with its documents' ids and numbers of features."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(_inverting(buckets, runs, min(block_docs, BLOCK_DOCS)), _POSTINGS)


def gain(s: Column, t: Column, corpus: int, target: int, buckets: int) -> Column:
    """The rounded log ratio of a bucket's smoothed shares in the target and in the corpus."""
    shares = (t + 1).cast("double") * F.lit(float(corpus + buckets)) / ((s + 1).cast("double") * F.lit(float(target + buckets)))
    return F.floor(F.lit(1000.0) * F.log(shares))


def importance(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, text_col: str = "text", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per document: doc_id, n_features, weight (the floored mean of its features' gains)."""
    with Scope(docs.sparkSession) as scope:
        corpus = materialize(postings(docs, runs, buckets, text_col, id_col, block_docs), "postings")
        wanted = materialize(postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text")), runs, buckets), "target_postings")
        size, size_wanted = (t.filter("bucket is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (corpus, wanted))
        heads = corpus.filter("bucket is not null").select("bucket", "block", "n", F.lit(0).alias("wanted"))
        heads = heads.unionByName(wanted.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("wanted")).select("bucket", F.lit(None).cast("long").alias("block"), F.lit(0).alias("n"), "wanted"))
        of_bucket = Window.partitionBy("bucket")
        gains = heads.select("bucket", "block", gain(F.sum("n").over(of_bucket), F.sum("wanted").over(of_bucket), size, size_wanted, buckets).alias("gain")).filter("block is not null")
        shared = corpus.filter("bucket is not null").select("bucket", "block", "places", "counts").join(gains, ["bucket", "block"])
        sums = shared.select("block", "gain", "places", "counts").sortWithinPartitions("block").mapInArrow(_contributing, "block long, places binary, sums binary")
        both = sums.select("block", "places", "sums", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("n_features"))
        both = both.unionByName(corpus.filter("bucket is null").select("block", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("sums"), "ids", "n_features"))
        weights = both.repartition("block").sortWithinPartitions("block").mapInArrow(_reducing, "doc_id long, n_features long, weight long")
        return scope.keep(materialize(weights, "weights"))


def deviate(doc_id: Column, seed: int) -> Column:
    """A Gumbel deviate in thousandths, from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weights: DataFrame, percent: int = 10, least_features: int = 20, seed: int = 2024) -> DataFrame:
    """Adds ``score`` and ``rank``: of the documents with enough features, ``percent`` of 100 with the highest scores have ranks from 1 on."""
    scored = weights.withColumn("score", F.col("weight") + deviate(F.col("doc_id"), seed))
    with Scope(scored.sparkSession) as scope:
        order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
        able = scored.filter(F.col("n_features") >= least_features)
        # The id that a task gives to its rows is its partition and the place within, here in sorted order.
        placed = materialize(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
        part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        counts = placed.groupBy(part.alias("part")).count()  # one row per range
        n = placed.count()
        before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
        rank = F.col("before") + place + 1
        ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").select(*weights.columns, "score", F.when(rank <= percent * n // 100, rank).alias("rank"))
        rest = scored.filter(~F.coalesce(F.col("n_features") >= least_features, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
        scope.keep(placed)
        return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, percent: int = 10, least_features: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn)."""
    return draw(importance(docs, target, runs, buckets), percent, least_features, seed)
