"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds by language.

A word's embedding is the sum of hashed ones, of the word and of its beginnings; filters of several widths slide over them; each filter's greatest value in the text goes
through a rectifier into a logistic output.  In the first epochs of training the pooling is soft, a mean that leans to the
greatest value more and more, since few labelled texts would teach a maximum too few words.  Features that few training texts have count zero.  Training takes
all labelled rows, in rounds of learning in the tasks (:mod:`playlake.llm.labelled`); scoring runs in the tasks over whole
texts; the products of a word's embedding with all filters are worked out once and remembered, so a word costs one look-up.

A text's score depends on the text alone.  A fifth of the labelled rows isn't trained on: it sets for each language the threshold
with the best F1, between :data:`THRESHOLDS`; a language with too few toxic texts there, and null, gets the one of all.

Defined results: null and empty texts get the score of a text without words; with no labelled rows, or only one label
value, all scores are that value's share (0 without rows); rows that repeat are scored one by one; columns beside
those named aren't read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from playlake.llm.decontaminate import words_of
from playlake.llm.labelled import learn_round, learning_rows, remainder, summed
from playlake.llm.scratch import Scope, materialize, small
from playlake.llm.worker import bound_batches, held

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, MIN_TEXTS, SEED = 8, 32, 0.05, 4, 7
#: Of the first epochs: how sharply pooling prefers the greatest value, so that at first all words learn from their text's label.
SHARPNESS = (0.3, 1.0, 3.0)
#: Rounds over all rows: so many that about VISITS texts are met, EPOCHS at most, MIN_ROUNDS at least.
VISITS, MIN_ROUNDS = 40_000, 3
#: Windows of a text that are looked at together.
STEP = 20_000
THRESHOLD, THRESHOLDS, MIN_TOXIC = 0.3, (0.2, 0.8), 10
_CACHE = 120_000
_TRIED = np.arange(THRESHOLDS[0], THRESHOLDS[1] + 1e-9, 0.02)
#: Bytes of a word's beginnings that have embeddings of their own.
PREFIXES = (4, 5, 6, 7, 8)


def features_of(words: list[bytes]) -> np.ndarray:
    """The buckets of each word: its own and those of its beginnings, so that forms of one root share what is learnt; 0: none."""
    found = np.zeros((len(words), 1 + len(PREFIXES)), np.int64)
    found[:, 0] = [xxhash.xxh32_intdigest(w) for w in words]
    found[:, 0] = found[:, 0] % (BUCKETS - 1) + 1
    lengths, most = np.fromiter(map(len, words), np.int64, len(words)), max(PREFIXES)
    heads = np.array(words, f"S{most}").view(np.uint8).reshape(-1, most).astype(np.uint32)  # words have no zero bytes
    h = np.full(len(words), 2166136261, np.uint32)
    for j in range(most):
        h = (h ^ heads[:, j]) * np.uint32(16777619)
        if j + 1 in PREFIXES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            found[:, 1 + PREFIXES.index(j + 1)] = np.where(lengths > j + 1, (mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS - 1) + np.uint32(1), 0)
    return found


def features(word: bytes) -> list[int]:
    return features_of([word])[0].tolist()


class _Rows(dict):
    """Word → row of ``table``, the products of its embedding with all filters; words without active features share row 0.

    The table has a fixed size; when it or the dictionary is full, both start anew.
    """

    def __init__(self, model: Model, limit: int = _CACHE):
        super().__init__()
        self.model, self.limit, self.used = model, limit, 1
        self.filters = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)
        self.table = np.zeros((limit + 1, self.filters.shape[1]), np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = words - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            self.used, new = 1, words
            if max(len(new), self.limit) + 1 != len(self.table):  # a text of very many words has as large a table, until the next start
                self.table = np.zeros((max(len(new), self.limit) + 1, self.filters.shape[1]), np.float32)
        new = sorted(new)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            found = features_of(part)
            found[~self.model.active[found]] = 0
            some = np.flatnonzero(found.any(axis=1))
            to = self.used + len(some)
            # By einsum each row is summed alike, whatever stands beside it: a text's score depends on the text alone.
            self.table[self.used : to] = np.einsum("nd,df->nf", self.model.embedding[found[some]].sum(axis=1), self.filters)
            self.update(dict.fromkeys(part, 0))
            self.update(zip((part[k] for k in some), range(self.used, to), strict=True))
            self.used = to


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' numbers in one array, each between zeros that are as wide as a filter reaches; and where each text's part starts.

    So no window holds words of two texts, and every filter meets an empty window in each: a pooled value is never below that of nothing.
    """
    gap = max(WIDTHS) - 1
    starts = np.cumsum([0, *(len(x) + 2 * gap for x in lists)])
    flat = np.zeros(int(starts[-1]) + gap, np.int64)
    for x, at in zip(lists, starts.tolist(), strict=False):
        flat[at + gap : at + gap + len(x)] = x
    return flat, starts


class Model:
    """Embeddings, filters (for each width an array of place x dimension x filter), biases, output."""

    def __init__(self, base: float = 0.0):
        rng = np.random.default_rng(SEED)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, 0.5 / w**0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(base)
        self.active = np.zeros(BUCKETS, bool)
        self.constant: float | None = None
        self.thresholds: dict[str | None, float] = {}

    # -- scoring

    def _convolved(self, looked: np.ndarray) -> np.ndarray:
        n = len(looked) - max(WIDTHS) + 1
        sums, at = [], 0
        for f in self.filters:
            part = looked[:n, at : at + FILTERS].copy()
            for j in range(1, len(f)):
                part += looked[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += len(f) * FILTERS
            sums.append(part)
        return np.concatenate(sums, axis=1)

    def scores(self, texts: list[str], rows: _Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):  # as many texts as make a fair piece of memory
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 150_000):
                size += len(texts[to])
                to += 1
            lists = [words_of(t) for t in texts[at:to]]
            rows.learn(set().union(*lists))
            flat, starts = _flat([np.fromiter(map(rows.__getitem__, x), np.int64, len(x)) for x in lists])
            pooled = np.full((to - at, FILTERS * len(WIDTHS)), -np.inf, np.float32)
            step, more = 20_000, max(WIDTHS) - 1
            for lo in range(0, int(starts[-1]), step):  # a long text is pooled piece by piece
                piece = self._convolved(rows.table[flat[lo : lo + step + more]])
                first = int(np.searchsorted(starts, lo, side="right")) - 1
                last = min(int(np.searchsorted(starts, lo + len(piece), side="left")), to - at)
                edges = np.maximum(starts[first:last], lo) - lo
                pooled[first:last] = np.maximum(pooled[first:last], np.maximum.reduceat(piece, edges, axis=0))
            hidden = np.maximum(pooled + self.bias, 0)
            out[at:to] = 1 / (1 + np.exp(-((hidden * self.out).sum(axis=1) + self.base).astype(np.float64)))
            at = to
        return out

    # -- training

    def fit(self, texts: list[str], y: np.ndarray) -> None:
        """Training in one place: stochastic gradient descent with per-parameter rates."""
        self.begin(texts_with(texts), float(y.mean()))
        state, rng = self.state(), np.random.default_rng(SEED)
        lists, feats = self._numbered(texts)
        for epoch in range(EPOCHS):
            self._descend(state, lists, feats, y, rng.permutation(len(lists)), lambda _, e=epoch: (RATE * (1 - e / EPOCHS), SHARPNESS[e] if e < len(SHARPNESS) else None))
        self.take(state)

    def begin(self, seen: np.ndarray, share: float) -> None:
        """Features that :data:`MIN_TEXTS` texts have are active (``seen``: how many have each); ``share`` of the texts have label 1."""
        self.active = seen >= MIN_TEXTS
        self.active[0] = False
        share = max(1e-3, min(1 - 1e-3, share))
        self.base = np.float32(np.log(share / (1 - share)))

    def state(self) -> dict[str, np.ndarray]:
        """What training changes, as arrays of rows: the parameters, and the sums of squares of their gradients."""
        found = {"e": self.embedding, "b": self.bias[None], "o": self.out[None], "base": np.array([[self.base]], np.float32)} | {f"f{i}": f.reshape(1, -1) for i, f in enumerate(self.filters)}
        return {k: a.copy() for k, a in found.items()} | {f"m{k}": np.full_like(a, 1e-6) for k, a in found.items() if k != "base"}

    def take(self, state: dict[str, np.ndarray]) -> None:
        self.embedding, self.bias, self.out, self.base = state["e"], state["b"][0], state["o"][0], np.float32(state["base"][0, 0])
        self.filters = [state[f"f{i}"].reshape(w, DIM, FILTERS) for i, w in enumerate(WIDTHS)]

    def _numbered(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Texts as rows of a table of words' active features; the row behind the last is no word."""
        words: dict[bytes, int] = {}
        lists = [np.array([words.setdefault(w, len(words)) for w in words_of(t)], np.int64) for t in texts]
        feats = features_of(list(words))
        feats[~self.active[feats]] = 0
        feats = np.concatenate([feats, np.zeros((1, feats.shape[1]), np.int64)])
        some = feats.any(axis=1)
        return [np.where(some[x], x, len(feats) - 1) if len(x) else x for x in lists], feats

    def learn(self, state: dict[str, np.ndarray], texts: list[str], y: np.ndarray, seed: list[int], turn: int, rounds: int) -> None:
        """One round's descent over ``texts``; the rate falls and pooling sharpens with the share of all rounds that is done."""
        lists, feats = self._numbered(texts)

        def now(part: float) -> tuple[float, float | None]:
            stage = int(EPOCHS * (turn + part) / rounds)
            return RATE * (1 - stage / EPOCHS), SHARPNESS[stage] if stage < len(SHARPNESS) else None

        self._descend(state, lists, feats, y, np.random.default_rng(seed).permutation(len(lists)), now)

    def _descend(self, state, lists: list[np.ndarray], feats: np.ndarray, y: np.ndarray, order: np.ndarray, now) -> None:
        self.take(state)  # views: what follows changes the state's arrays
        for lo in range(0, len(order), BATCH):
            (rate, sharpness), own = now(lo / len(order)), order[lo : lo + BATCH]
            flat, starts = _flat([lists[k] + 1 for k in own])
            flat = np.where(flat == 0, len(feats) - 1, flat - 1)
            met, flat = np.unique(flat, return_inverse=True)
            vectors = self.embedding[feats[met]].sum(axis=1)
            table = np.concatenate([vectors @ f[j] for f in self.filters for j in range(len(f))], axis=1)
            parts = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            pooled, top, best, norm = map(np.stack, zip(*(self._pooled(table, flat, a, b, sharpness) for a, b in parts), strict=True))
            pooled = pooled + self.bias
            hidden = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(hidden @ self.out + self.base)))
            g = ((p - y[own]) / len(own)).astype(np.float32)
            back = (g[:, None] * self.out) * (pooled > 0)
            self._step("o", self.out, hidden.T @ g, rate, state)
            self._step("b", self.bias, back.sum(axis=0), rate, state)
            self.base -= np.float32(rate * g.sum())
            sums = self._sums(table, flat, parts, top, best, norm, back, sharpness)
            total, column = np.zeros((len(met), DIM), np.float32), 0
            for i, f in enumerate(self.filters):
                d = np.zeros_like(f)
                for j in range(len(f)):
                    part = sums[:, column : column + FILTERS]
                    column += FILTERS
                    total += part @ f[j].T
                    d[j] = vectors.T @ part
                self._step(f"f{i}", f, d, rate, state)
            some = np.flatnonzero(total.any(axis=1))
            rows, grads = feats[met[some]].ravel(), np.repeat(total[some], feats.shape[1], axis=0)
            rows, grads = rows[rows > 0], grads[rows > 0]
            used, place = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(place, grads[:, k], len(used)) for k in range(DIM)], axis=1).astype(np.float32)
            state["me"][used] += total**2
            self.embedding[used] -= rate * total / np.sqrt(state["me"][used])
        state["base"][0, 0] = self.base

    def _windows(self, table: np.ndarray, flat: np.ndarray, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """A text's windows piece by piece: where a piece starts, and each window's value for each filter."""
        for lo in range(a, b, STEP):
            yield lo, self._convolved(table[flat[lo : min(lo + STEP, b) + max(WIDTHS) - 1]])

    def _pooled(self, table: np.ndarray, flat: np.ndarray, a: int, b: int, sharpness: float | None) -> tuple[np.ndarray, ...]:
        """A text's value for each filter; where its greatest window starts; that window's value; and, with soft pooling, the sum of all windows' weights."""
        n, once = FILTERS * len(WIDTHS), list(self._windows(table, flat, a, b)) if b - a <= STEP else None
        best, top, norm, total = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64), np.zeros(n, np.float32), np.zeros(n, np.float32)
        for lo, conv in once or self._windows(table, flat, a, b):
            at = conv.argmax(axis=0)
            value = conv[at, np.arange(n)]
            more = value > best
            best[more], top[more] = value[more], lo + at[more]
        if sharpness is None:
            return best, top, best, norm
        for _, conv in once or self._windows(table, flat, a, b):
            w = np.exp(sharpness * (conv - best))
            norm += w.sum(axis=0)
            total += (w * conv).sum(axis=0)
        return total / norm, top, best, norm

    def _sums(self, table: np.ndarray, flat: np.ndarray, parts: list[tuple[int, int]], top: np.ndarray, best: np.ndarray, norm: np.ndarray, back: np.ndarray, sharpness: float | None) -> np.ndarray:
        """For each word and each place of each filter the gradient that its windows bring: the greatest ones, or, with soft pooling, all, some hundred thousand windows at a time."""
        sums = np.zeros((len(table), table.shape[1]), np.float32)
        places = [(i * FILTERS, j) for i, f in enumerate(self.filters) for j in range(len(f))]
        if sharpness is None:
            for k, (q, j) in enumerate(places):
                cols = slice(q, q + FILTERS)
                np.add.at(sums[:, k * FILTERS : (k + 1) * FILTERS], (flat[top[:, cols] + j], np.arange(FILTERS)), back[:, cols])
            return sums
        held, size, first = [], 0, 0

        def add() -> None:
            d = np.concatenate(held)
            for k, (q, j) in enumerate(places):
                words = flat[first + j : first + j + len(d)]
                for c in range(FILTERS):
                    sums[:, k * FILTERS + c] += np.bincount(words, d[:, q + c], len(table))

        for (a, b), high, weight, own in zip(parts, best, norm, back, strict=True):
            for _, conv in self._windows(table, flat, a, b):
                held.append(np.exp(sharpness * (conv - high)) * (own / weight))
                size += len(conv)
                if size > 400_000:
                    add()
                    held, first, size = [], first + size, 0
        if held:
            add()
        return sums

    @staticmethod
    def _step(key, value, grad, rate, state) -> None:
        memory = state["m" + key].reshape(value.shape)
        memory += grad**2
        value -= rate * grad / np.sqrt(memory)


def texts_with(texts: list[str]) -> np.ndarray:
    """How many of ``texts`` have each feature."""
    words: dict[bytes, int] = {}
    lists = [np.array([words.setdefault(w, len(words)) for w in set(words_of(t))], np.int64) for t in texts]
    feats, seen = features_of(list(words)), np.zeros(BUCKETS, np.int64)
    for x in lists:
        seen[np.unique(feats[x])] += 1
    return seen


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", lang_col: str = "lang") -> Model:
    """A model from all labelled rows, and its thresholds by language."""
    model = Model()
    with Scope(docs.sparkSession):
        found = learning_rows(docs, labels, label, usable, (lang_col,))
        kept = F.pmod(F.shiftrightunsigned("turn", 32), F.lit(5)) == 0  # by the hash: these set the thresholds
        n, share, low, high, learnt, learnt_share = found.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), F.count_if(~kept), F.avg(F.when(~kept, F.col("y")))).first()
        if low == high:
            model.constant = float(share) if n else 0.0
            model.thresholds = {None: THRESHOLD}
            return model
        rows = found.filter(~kept)
        if learnt:
            model.begin(summed(rows, texts_with, BUCKETS), float(learnt_share))
            rounds, state = max(MIN_ROUNDS, min(EPOCHS, VISITS // learnt)), model.state()
            for turn in range(rounds):
                learn_round(rows, state, functools.partial(_learn, model.active, turn, rounds))
            model.take(state)
        model.thresholds = _thresholds(found.filter(kept), model, lang_col)
    return model


def _learn(active: np.ndarray, turn: int, rounds: int, state: dict[str, np.ndarray], segment: int, texts: list[str], y: np.ndarray) -> None:
    model = Model.__new__(Model)
    model.active = active
    model.learn(state, texts, y, [SEED, segment, turn], turn, rounds)


def _thresholds(rows: DataFrame, model: Model, lang_col: str) -> dict[str | None, float]:
    """The threshold of all rows (null), and those of the languages that have enough toxic ones; rows: text, y and the language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    narrow = rows.select(F.col(lang_col).alias("lang"), F.col("y").cast("double").alias("y"), "text")
    scored = narrow.mapInArrow(_scoring(shared, uuid.uuid4().hex), "lang string, y double, score double")
    reached = sum((F.col("score") >= float(t)).cast("int") for t in _TRIED)
    # As many rows as languages times thresholds.
    counts = scored.groupBy("lang", reached.alias("reached")).agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).collect()
    shared.destroy()
    by_lang: dict[str | None, np.ndarray] = {None: np.zeros((2, len(_TRIED) + 1))}
    for r in counts:
        for lang in {None, r["lang"] or None}:
            by_lang.setdefault(lang, np.zeros((2, len(_TRIED) + 1)))[:, r["reached"]] += r["n"], r["toxic"]
    return {lang: _best(*own) for lang, own in sorted(by_lang.items(), key=lambda x: x[0] or "") if lang is None or own[1].sum() >= MIN_TOXIC}


def _best(n: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1; ``n`` and ``toxic``: how many rows, and toxic ones, reach just so many thresholds."""
    over, right = np.cumsum(n[::-1])[::-1][1:], np.cumsum(toxic[::-1])[::-1][1:]
    f1 = 2 * right / np.maximum(1, over + toxic.sum())
    return round(float(_TRIED[f1 == f1.max()].mean()), 3)


def _scoring(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = held(key, lambda: (shared.value, _Rows(shared.value)))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(texts, rows), pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def _scored(docs: DataFrame, model: Model, text_col: str, id_col: str, lang_col: str):
    """The rows of :func:`score` and the broadcast that they need."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by the model's constants
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(_scoring(shared, uuid.uuid4().hex), narrow.select("doc_id", "lang").withColumn("score", F.lit(0.0)).schema)
    limit = F.lit(model.thresholds[None])
    for lang, value in model.thresholds.items():
        if lang is not None:
            limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    return scored.withColumn("lang_threshold", limit).withColumn("toxic", F.col("score") >= limit), shared


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, score, lang_threshold, toxic (the score reaches the language's threshold)."""
    return _scored(docs, model, text_col, id_col, lang_col)[0]


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted; and lang_threshold, toxic."""
    model = train(docs, labels, remainder(F.col("doc_id"), modulus) != held)
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", "toxic")


def without_toxic(docs: DataFrame, corpus: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` below their language's threshold; the model comes from the labelled rows of ``corpus``."""
    model = train(corpus, labels, remainder(F.col("doc_id"), modulus) != held)
    scored, shared = _scored(docs, model, "text", "doc_id", "lang")
    bad = materialize(scored.filter("toxic").select(F.col("doc_id").alias("bad_id")).distinct(), "toxic")
    shared.destroy()  # the decisions are written; executors and driver give the model's memory back
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
