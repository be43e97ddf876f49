"""Near duplicates: MinHash signatures, banding, verification, connected components.

Documents are sets of five-word shingles.  Two are linked when the Jaccard similarity of their full sets is 0.75 or
more; the result names each document's component.

1. Each text becomes a set of 64-bit shingle hashes and 128 minima of universal hash functions.  Documents with the same
   set are one node of the graph, so copies cost nothing from here on.
2. 32 bands of 4 minima are the bucket keys.  Similarity 0.75 shares a bucket with a chance of 1 - (1 - 0.75^4)^32 =
   0.999995, more similarity with a greater one.
3. Each bucket of several nodes is dealt into blocks of bounded size, and each two blocks meet in one row of a task.  First only
   signatures meet, which tells the nodes that have a partner: sizes and signatures agree well enough.  Then the full sets of
   those prove the links.  The pairs are walked within the row, a union-find over its nodes skips what is linked already, and
   only a link that joins two components leaves the task: fewer rows than the blocks have nodes, however many pairs are
   alike.  A pair is looked at in the first bucket that it shares, so each is decided once, exactly, and none is left out.
4. Alternating large-star and small-star makes components of the links.

Defined results: a null text and a text without words have the empty set, no links, and stay; a text of fewer than five
words has its whole sequence as one shingle; rows that repeat a doc_id belong to its component and stay together; null
doc_ids come last in the order of the smallest; columns beside id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from playlake.llm.components import connected_components
from playlake.llm.scratch import Scope, materialize, small
from playlake.llm.worker import bound_batches, held

SHINGLE_WORDS, SIMILARITY = 5, 75
HASHES, BAND_ROWS = 128, 4
BANDS = HASHES // BAND_ROWS
#: Six standard deviations of the estimate below the similarity.
SIGNATURE_FLOOR = SIMILARITY / 100 - 6 * (0.75 * 0.25 / HASHES) ** 0.5
#: Signatures and sets of one block of a bucket.
BLOCK_BYTES = 1 << 20
_WORD_CACHE = 200_000

_rng = np.random.default_rng(20240101)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(total)]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        values = x[at : at + 1024, None] * _MULTIPLY
        values += _ADD
        np.minimum(least, values.min(axis=0), out=least)
    return least


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, marks, signs = [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            sizes.append(len(found))
            marks.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
            signs.append(signature(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "mark", "signature"])


def _band_keys(signs: np.ndarray) -> np.ndarray:
    """The bucket of each band of signatures, as rows of longs."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signs), BANDS)).copy()
    for j in range(BAND_ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signs.reshape(-1, BANDS, BAND_ROWS)[:, :, j].astype(np.uint64))
    return keys.astype(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _band_keys(_signatures(batch.column("signature")))
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], [*batch.schema.names, "keys"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py()) for text in batch.column("text")]
        marks = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["mark", "shingles"])


class _Meeting:
    """The nodes of one or two blocks of a bucket: arrays of node, component, number of shingles, side, and signatures."""

    def __init__(self, band: int, nodes: pa.StructArray, sides: np.ndarray):
        self.band, self.nodes, self.sides = band, nodes.field("node").to_numpy(), sides
        self.label, self.size = np.arange(len(nodes)), nodes.field("size").to_numpy()
        self.signs = _signatures(nodes.field("signature"))
        #: Two sides: pairs within a side meet elsewhere.
        self.two = len(set(sides.tolist())) == 2

    def partners(self, at: int) -> np.ndarray:
        """Later nodes of other components that may be similar to one, and share no earlier bucket with it; the likeliest first."""
        rest = slice(at + 1, None)
        low, high = np.minimum(self.size[rest], self.size[at]), np.maximum(self.size[rest], self.size[at])
        may = (self.label[rest] != self.label[at]) & (100 * low >= SIMILARITY * high)
        if self.two:
            may &= self.sides[rest] != self.sides[at]
        found = np.flatnonzero(may) + at + 1
        same = self.signs[found] == self.signs[at]
        first = same.reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1) == self.band
        share = same.mean(axis=1)
        fine = first & (share >= SIGNATURE_FLOOR)
        return found[fine][np.argsort(-share[fine], kind="stable")]

    def needed(self) -> np.ndarray:
        """Whether each node has a partner."""
        out = np.zeros(len(self.nodes), bool)
        for at in range(len(self.nodes)):
            found = self.partners(at)
            out[found] = True
            out[at] |= len(found) > 0
        return out

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links that join two components, which are one from then on.

        Of the partners in one component the likeliest are compared first, and the others only as long as none is linked.
        """
        for at in range(len(self.nodes)):
            found, width = self.partners(at), 1
            while len(found):
                order = np.argsort(self.label[found], kind="stable")
                label = self.label[found][order]
                turn = np.arange(len(order)) - np.searchsorted(label, label)
                now = found[np.sort(order[turn < width])]
                for k in now[self._similar(sets, at, now)]:
                    if self.label[k] != self.label[at]:
                        self.label[self.label == self.label[k]] = self.label[at]
                        yield int(self.nodes[at]), int(self.nodes[k])
                found = found[~np.isin(found, now) & (self.label[found] != self.label[at])]
                width *= 4

    def _similar(self, sets: list[np.ndarray], at: int, others: np.ndarray) -> np.ndarray:
        """Which of the others' sets are similar enough to one."""
        own, ends = sets[at], np.cumsum(self.size[others])
        flat = np.concatenate([sets[k] for k in others])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.diff(np.concatenate([[0], np.cumsum(own[place] == flat)[ends - 1]]))
        return 100 * both >= SIMILARITY * (len(own) + self.size[others] - both)


def _needing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each two blocks whose sets have to be compared."""
    names = ("key", "band", "i", "j", "side", "node")
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            parts = [batch.column(c)[row].values for c in ("left", "right") if batch.column(c)[row].is_valid]
            sides = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            meeting = _Meeting(batch.column("band")[row].as_py(), pa.concat_arrays(parts), sides)
            need = np.flatnonzero(meeting.needed())
            out.append([*(np.full(len(need), batch.column(c)[row].as_py()) for c in names[:4]), sides[need], meeting.nodes[need]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64 if c in ("key", "node") else np.int32)) for k, c in enumerate(names)], names)


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for row in range(batch.num_rows):
            nodes = batch.column("nodes")[row].values
            meeting = _Meeting(batch.column("band")[row].as_py(), nodes, nodes.field("side").to_numpy())
            links += meeting.links([s.values.to_numpy().view(np.uint64) for s in nodes.field("shingles")])
        yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["u", "v"])


def _with_shingles(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, size, signature, shingles) of those nodes that share a bucket, from the texts of their least documents."""
    wanted = materialize(nodes.join(small(needed), "node", "left_semi").select("node", "mark", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "signature"), "wanted")
    ids = small(materialize(wanted.select("rep").distinct(), "ids"))
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi").select("text")
    found = texts.mapInArrow(_with_sets, "mark binary, shingles array<bigint>").dropDuplicates(["mark"])
    return materialize(found.join(wanted, "mark").select("node", "size", "signature", "shingles"), "sets")


def bucket_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) between nodes that share a bucket: enough of them that all linked nodes of a bucket are connected."""
    bands = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    members = materialize(bands.join(small(shared), "key", "left_semi").select("key", "band", "node"), "members")
    sets = _with_shingles(docs, nodes, materialize(members.select("node").distinct(), "needed"))
    signs = sets.select("node", "size", "signature")
    held = materialize(members.join(signs, "node"), "held")
    weight = held.groupBy("key").agg(F.ceil(F.sum(F.col("size") * 8 + 4 * HASHES) / BLOCK_BYTES).cast("int").alias("blocks"))
    large = materialize(weight.filter("blocks > 1"), "large")
    dealt = held.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).repartition("key", "block")
    blocks = dealt.groupBy("key", "block", "band", "blocks").agg(F.collect_list(F.struct("node", "size", "signature")).alias("nodes"))
    blocks = materialize(blocks, "blocks")
    nothing = F.lit(None).cast(blocks.schema["nodes"].dataType)
    alone = blocks.select("key", "band", F.col("block").alias("i"), F.col("block").alias("j"), F.col("nodes").alias("left"), nothing.alias("right"))
    several = blocks.filter("blocks > 1")
    left = several.filter("block < blocks - 1").select("key", "band", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"), F.col("nodes").alias("left"))
    right = several.filter("block > 0").select("key", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("nodes").alias("right"))
    meetings = alone.unionByName(left.join(right, ["key", "i", "j"]))
    needed = materialize(meetings.mapInArrow(_needing, "key long, band int, i int, j int, side int, node long"), "needed")
    rows = sets.join(small(needed), "node").groupBy("key", "band", "i", "j").agg(F.collect_list(F.struct("node", "size", "signature", "side", "shingles")).alias("nodes"))
    return materialize(rows.select("band", "nodes").mapInArrow(_linking, "u long, v long").distinct(), "links")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Scope(docs.sparkSession) as scope:
        signed = materialize(texts.mapInArrow(_signed, "doc_id long, n_shingles long, mark binary, signature binary"), "signed")
        nodes = signed.filter("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
        nodes = nodes.withColumn("node", F.monotonically_increasing_id())
        nodes = materialize(nodes.mapInArrow(_banded, f"{nodes.schema.simpleString()[7:-1]},keys:array<bigint>"), "nodes")
        rows = materialize(signed.select("doc_id", "n_shingles", "mark"), "rows")
        labels = connected_components(bucket_links(texts, nodes))
        placed = materialize(nodes.join(labels, "node", "left").select("mark", "doc_id", F.coalesce("label", "node").alias("label")), "placed")
        least = materialize(placed.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
        named = scope.keep(materialize(placed.join(least, "label").select("mark", "component_id"), "named"))
        scope.keep(rows)
    out = rows.join(named, "mark", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id stays; of rows that repeat an id, all stay."""
    with Scope(docs.sparkSession) as scope:
        gone = near_duplicates(docs, text_col, id_col).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept")).filter("not kept").select("gone_id")
        gone = scope.keep(materialize(gone, "gone"))
    return docs.join(small(gone), docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")
