"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, with a softmax output.

A document's features are its words (runs without white space, case kept), pairs of neighbouring words (a word after itself
counts as the one pair "same"), and the character n-grams of each word between ``<`` and ``>``.  The average of their hashed
vectors goes into a softmax over the two label values.  Training is stochastic gradient descent in numpy, over
all labelled rows, in rounds of learning in the tasks (:mod:`playlake.llm.labelled`).  Since the output is linear in the average, scoring
needs one number for each bucket: a word's sum over its n-grams is worked out once and remembered, so whole texts cost
a look-up for each word and one for each pair.

Defined results: null and empty texts have no features and get the score of the bias alone; with no labelled rows, or only
one label value, all scores are that value's share (0 without rows); rows that repeat are scored one by one; columns
beside those named aren't read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from playlake.llm.labelled import learn_round, learning_rows, remainder
from playlake.llm.scratch import Scope
from playlake.llm.worker import bound_batches, held

BUCKETS, DIM, N_GRAMS = 1 << 18, 8, (3, 4)
EPOCHS, RATE, SEED, THRESHOLD = 6, 4.0, 11, 0.3
#: The epochs are shared out over so many rounds.
ROUNDS = 2
_CACHE = 300_000
_PAIR, _SAME = np.uint64(0x9E3779B97F4A7C15), 0


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): of each word its own bucket and those of its character n-grams (of UTF-8 bytes), words one after another."""
    marked = [b"<" + w + b">" for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    stream = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    own = np.array([word_hash(w) % (BUCKETS - 1) + 1 for w in words], np.int64)
    parts, owners = [own], [np.arange(len(words))]
    for n in N_GRAMS:
        counts = np.maximum(lengths - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ stream[at + j]) * np.uint64(0x100000001B3)
        h = (h ^ (h >> np.uint64(29))) * _PAIR
        parts.append(((h >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1)
        owners.append(owner)
    buckets, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours in a list of word hashes."""
    left, right = hashes[:-1], hashes[1:]
    h = (left * np.uint64(3) + right) * _PAIR
    found = ((h >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    found[left == right] = _SAME
    return found


class Model:
    """The bucket vectors and the output layer."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.constant: float | None = None

    def fit(self, texts: list[str], y: np.ndarray) -> None:
        """Training in one place."""
        self.begin(float(y.mean()))
        state = self.state()
        self.learn(state, texts, y, SEED, 0, 1)
        self.take(state)

    def begin(self, share: float) -> None:
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.bias[:] = np.log([1 - share, share])

    def state(self) -> dict[str, np.ndarray]:
        """What training changes, as arrays of rows."""
        return {"vectors": self.vectors.copy(), "out": self.out.reshape(1, -1).copy(), "bias": self.bias[None].copy()}

    def take(self, state: dict[str, np.ndarray]) -> None:
        self.vectors, self.out, self.bias = state["vectors"], state["out"].reshape(DIM, 2), state["bias"][0]

    def learn(self, state: dict[str, np.ndarray], texts: list[str], y: np.ndarray, seed, turn: int, rounds: int) -> None:
        """One round's epochs over ``texts``; the rate falls with the share of all that is done."""
        docs = []
        for text in texts:
            words = text.encode().split()
            distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
            if not words:
                docs.append((np.empty(0, np.int32), np.empty(0, np.float32)))
                continue
            buckets, counts = subwords(list(distinct))
            times = np.bincount(np.array([distinct[w] for w in words]), minlength=len(distinct))
            weights = np.repeat(times, counts)
            hashes = np.array([word_hash(w) for w in words], np.uint64)
            p = pairs(hashes)
            used, place = np.unique(np.concatenate([buckets, p]), return_inverse=True)
            weight = np.bincount(place, np.concatenate([weights, np.ones(len(p))]))
            docs.append((used.astype(np.int32), (weight / weight.sum()).astype(np.float32)))
        self.take(state)  # views: what follows changes the state's arrays
        rng = np.random.default_rng(seed)
        own = range(EPOCHS * turn // rounds, EPOCHS * (turn + 1) // rounds)
        steps, done = EPOCHS * len(docs), own.start * len(docs)
        for _ in own:
            for k in rng.permutation(len(docs)):
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                used, weight = docs[k]
                rows = self.vectors[used]
                mean = weight @ rows
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(y[k])] -= 1
                back = self.out @ p
                self.out -= rate * 0.1 * np.outer(mean, p)
                self.bias -= rate * np.float32(0.01) * p
                if len(used):
                    self.vectors[used] = rows - (rate * weight)[:, None] * back

    def table(self) -> np.ndarray:
        """For each bucket how much it speaks for label 1."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)


class Scorer:
    """Scores texts in a task, remembering words."""

    def __init__(self, model: Model):
        self.model, self.table, self.known = model, model.table(), {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > _CACHE:
            self.known.clear()
            self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)
        new = [w for w in words if w not in self.known]
        if not new:
            return
        buckets, counts = subwords(new)
        self.known.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
        ends = np.cumsum(counts) - counts
        self.sums = np.concatenate([self.sums, np.add.reduceat(self.table[buckets], ends)])
        self.counts = np.concatenate([self.counts, counts])
        self.hashes = np.concatenate([self.hashes, np.array([word_hash(w) for w in new], np.uint64)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        out = np.zeros(len(texts))
        bias = float(self.model.bias[1] - self.model.bias[0])
        for lo in range(0, len(texts), 64):
            part = [t.encode().split() for t in texts[lo : lo + 64]]
            self._learn(set().union(*part))
            for k, words in enumerate(part, lo):
                if words:
                    rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    total = self.sums[rows].sum() + self.table[pairs(self.hashes[rows])].sum()
                    out[k] = total / (self.counts[rows].sum() + len(rows) - 1)
        return 1 / (1 + np.exp(-(out + bias)))


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "quality") -> Model:
    """A model from all labelled rows."""
    model = Model()
    with Scope(docs.sparkSession):
        found = learning_rows(docs, labels, label, usable)
        n, share, low, high = found.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
        if low == high:
            model.constant = float(share) if n else 0.0
            return model
        model.begin(float(share))
        state = model.state()
        for turn in range(ROUNDS):
            learn_round(found, state, functools.partial(_learn, turn, ROUNDS))
        model.take(state)
    return model


def _learn(turn: int, rounds: int, state: dict[str, np.ndarray], segment: int, texts: list[str], y: np.ndarray) -> None:
    Model.__new__(Model).learn(state, texts, y, [SEED, segment, turn], turn, rounds)


def _scoring(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(texts), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: better)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, 8 MB
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_scoring(shared, uuid.uuid4().hex), narrow.select("doc_id").withColumn("score", F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = train(docs, labels, remainder(F.col("doc_id"), modulus) != held)
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
