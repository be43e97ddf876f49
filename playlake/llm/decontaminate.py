"""Benchmark decontamination with suffix arrays of the training texts.

A task turns each shard of its documents, some hundred thousand words, into one stream of word numbers, a separator between
documents.  Sorting the positions of the stream by the words that follow (prefix doubling) gives the shard's suffix array.
Every suffix of the benchmark texts is looked up by binary search; suffixes that begin with the same window are looked up once,
and know the items that have them.  The range that is found holds all places of the window, and each match there is followed as
far as it goes, among the block's suffixes that begin so, sorted likewise.  What :func:`benchmark_hits` marks is the union of these
longest matches, and it reports each document's longest.  A place whose match is the rest of the one a word before isn't followed
again.  :func:`longest_matches` has the same from the other side: each suffix's longest match and one of its places.

Only words of the benchmark have numbers; every other word is a zero, which equals nothing.  A suffix that begins with a
zero can't match, so it isn't put in the array.  Words are compared as bytes, never by hash.

The benchmark is dealt in blocks of at most :data:`BLOCK_WORDS` words, four bytes each besides the vocabulary.  A pass over the
documents meets the blocks of at most :data:`PASS_WORDS` words, and a worker holds one of them at a time; a larger benchmark
takes several passes over numbered documents, whose marked words are united.

Defined results: a null text has no words and no hits; a benchmark text without words, or null, has no window; one
shorter than the window is a window of its own; items that repeat are one item; texts with a null item_id are left out, or
with ``null_items`` mark words and count together as one item without a name, as SQL has it; an
empty benchmark leaves all documents clean; rows that repeat are judged one by one; columns beside id and text aren't
read; a document of any length is one part of its shard, and an item of any length one part of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playlake.llm.scratch import Scope, materialize, small
from playlake.llm.worker import bound_batches

WINDOW_WORDS, SHARE = 13, 20
SHARD_WORDS, BLOCK_WORDS, PASS_WORDS = 400_000, 500_000, 8_000_000
_AT_ONCE = 50_000
# Bytes that aren't part of a word are 00-2F, 3A-60 (once A-Z are folded) and 7B-7F.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z folded."""
    return text.encode().translate(_FOLD).split() if text else []


class Words:
    """A stream of word numbers."""

    def __init__(self, stream: np.ndarray, window: int = WINDOW_WORDS):
        self.window, self.stream = window, np.concatenate([stream, np.zeros(window, np.int32)])

    def words(self, place: np.ndarray, offset: int, size: np.ndarray) -> np.ndarray:
        """A window's worth of words from each place plus ``offset`` on; zeros behind its ``size``."""
        columns = np.arange(self.window)
        found = self.stream[np.minimum(place[:, None] + offset + columns, len(self.stream) - 1)]
        found[columns >= size[:, None]] = 0
        return found


class Queries(Words):
    """A block of benchmark texts: its vocabulary, its words in one stream, its different windows and its own suffix array."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW_WORDS):
        items = [(item, words) for item, words in items if words]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.names = [item for item, _ in items]
        self.lengths = np.array([len(words) for _, words in items], np.int64)
        flat = np.fromiter((self.vocabulary[w] for _, words in items for w in words), np.int32, int(self.lengths.sum()))
        super().__init__(flat, window)
        self.longest = int(self.lengths.max(initial=0))
        owner, at, left = self.suffixes()
        place = np.flatnonzero((left >= window) | (at == 0))
        words = self.words(place, 0, np.minimum(left[place], window))
        distinct, kind = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, np.empty(0, np.int64))
        #: Of each different window its first place and its number of words; and its items, one window's after another's.
        kind = kind.ravel()
        self.first = np.zeros(len(distinct), np.int64)
        self.first[kind[::-1]] = place[::-1]
        self.size = (distinct > 0).sum(axis=1)
        pairs = np.unique(np.stack([kind, owner[place]], axis=1), axis=0) if len(place) else np.empty((0, 2), np.int64)
        self.items, self.ends = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(distinct)), side="right")
        #: Where each text begins in a stream with a zero after each, that stream's suffix array, and each window's range of it.
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        apart = np.zeros(len(flat) + len(self.lengths), np.int32)
        apart[np.arange(len(flat)) + owner] = flat
        self.array = SuffixArray(apart, window, self.longest)
        self.low, self.high = self.array.ranges(self, self.first, self.size)
        #: The window that follows a window wherever the block has either, else -1.
        self.successor = self._successors(place, kind, owner, left)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: whose it is (a place in ``names``), its place in the text, and how many words are left from it on."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        at = np.arange(len(owner)) - (np.cumsum(self.lengths) - self.lengths)[owner]
        return owner, at, self.lengths[owner] - at

    def _successors(self, place: np.ndarray, kind: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
        follows = np.full(len(place), -1, np.int64)
        if len(place):
            next_to = (place[1:] == place[:-1] + 1) & (owner[place[1:]] == owner[place[:-1]]) & (left[place[1:]] >= self.window)
            follows[:-1] = np.where(next_to, kind[1:], -1)
        count, least, greatest = np.bincount(kind, minlength=len(self.first)), np.full(len(self.first), len(self.first), np.int64), np.full(len(self.first), -1, np.int64)
        np.minimum.at(least, kind, follows)
        np.maximum.at(greatest, kind, follows)
        # As many places have the one as the other, and each of the one is followed by the other: so none of the other stands alone.
        return np.where((least == greatest) & (least >= 0) & (count[greatest] == count), greatest, -1)


class SuffixArray:
    """The suffixes of a shard, sorted by their first ``depth`` words."""

    def __init__(self, stream: np.ndarray, window: int = WINDOW_WORDS, depth: int | None = None):
        self.window, depth = window, max(window, depth or 0)
        self.stream = np.concatenate([stream, np.zeros(depth + window, stream.dtype)])
        rank = np.concatenate([stream.astype(np.int64), np.zeros(depth, np.int64)])
        places, reach = np.flatnonzero(stream), 1
        order = np.argsort(rank[places], kind="stable")
        while reach < depth and len(places):
            step = min(reach, depth - reach)
            # The order by ``reach`` words at a place and at ``step`` words after it is the order by their sum; the base exceeds
            # every rank of the round, also the first's word numbers, which run up to the vocabulary and not to the shard's length.
            key = rank[places] * (int(rank.max()) + 1) + rank[places + step]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) + 1
            rank = np.zeros_like(rank)
            rank[places[order]] = new
            reach += step
            if new[-1] == len(places):  # no two are alike any more
                break
        self.places = places[order]

    def _bound(self, words: np.ndarray, size: np.ndarray, after: bool, lo: np.ndarray, hi: np.ndarray, offset: int) -> np.ndarray:
        """For each query, the first suffix between lo and hi whose words from ``offset`` on aren't less (or, with ``after``, are greater)."""
        lo, hi, columns = lo.copy(), hi.copy(), np.arange(self.window)
        mask = columns < size[:, None]
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) // 2
            found = self.stream[self.places[mid][:, None] + offset + columns]
            differs = (found != words[todo]) & mask[todo]
            first = differs.argmax(axis=1)
            some = differs[np.arange(len(todo)), first]
            less = found[np.arange(len(todo)), first] < words[todo, first]
            right = np.where(some, less, after)
            lo[todo[right]] = mid[right] + 1
            hi[todo[~right]] = mid[~right]
        return lo

    def ranges(self, queries: Queries, place: np.ndarray, size: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that have the queries' ``size`` words from ``offset`` on, within the ranges lo to hi."""
        lo = np.zeros(len(place), np.int64) if lo is None else lo
        hi = np.full(len(place), len(self.places), np.int64) if hi is None else hi
        low, high = lo.copy(), hi.copy()
        for at in range(0, len(place), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            words = queries.words(place[part], offset, size[part])
            low[part] = self._bound(words, size[part], False, lo[part], hi[part], offset)
            high[part] = self._bound(words, size[part], True, low[part], hi[part], offset)
        return low, high

    def longest(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of the block the length of its longest match and one place of it (-1: none)."""
        left = queries.suffixes()[2]
        return self.follow(queries, np.arange(len(left)), left)

    def follow(self, source: Words, place: np.ndarray, left: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each place of ``source``, with ``left`` words from it on, the length of the longest match among the suffixes lo to hi and one place of it (-1: none).

        Where a window's worth of words is there, the next ones are looked for among the suffixes that have these, and so on; where
        it isn't, the neighbours of its place in the order have the most of it.  The array must be sorted as deep as matches are long.
        """
        length, found = np.zeros(len(place), np.int64), np.full(len(place), -1)
        if not len(self.places):
            return length, found
        open_, columns, offset = np.arange(len(place)), np.arange(self.window), 0
        lo = np.zeros(len(place), np.int64) if lo is None else lo
        hi = np.full(len(place), len(self.places), np.int64) if hi is None else hi
        while len(open_):
            size = np.minimum(left[open_] - offset, self.window)
            low, high = self.ranges(source, place[open_], size, lo, hi, offset)
            whole = low < high
            for at in range(0, len(open_), _AT_ONCE):
                part = slice(at, at + _AT_ONCE)
                words = source.words(place[open_[part]], offset, size[part])
                for neighbour in (np.maximum(low[part] - 1, lo[part]), np.minimum(low[part], hi[part] - 1)):
                    there = self.places[neighbour]
                    same = (self.stream[there[:, None] + offset + columns] == words) & (columns < size[part][:, None])
                    reach = offset + np.where(same.all(axis=1), self.window, (~same).argmax(axis=1))
                    better = reach > length[open_[part]]
                    length[open_[part][better]], found[open_[part][better]] = reach[better], there[better]
            further = whole & (left[open_] - offset > self.window)
            open_, lo, hi, offset = open_[further], low[further], high[further], offset + self.window
        return length, found


def _items(benchmark: DataFrame, text_col: str, item_col: str, null_items: bool) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter(f"({str(null_items).lower()} or item is not null) and text is not null").distinct()
    return materialize(items.withColumn("bytes", F.octet_length("text")), "items")


def _passes(items: DataFrame, window: int, block_words: int, pass_words: int):
    """Lists of broadcast :class:`Queries`, a pass's blocks each."""
    total = items.agg(F.sum("bytes")).first()[0] or 0
    # A word is two bytes at least with its separator, so blocks of equal shares stay near the bound; long items fill one alone.
    count = max(1, -(-total // (2 * block_words)))
    if count > 1:  # each block is read by itself
        numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int"))
        items = materialize(numbered.repartition("block"), "blocks", by="block")
    at_once = max(1, pass_words // block_words)
    for first in range(0, count, at_once):
        blocks = []
        for k in range(first, min(count, first + at_once)):
            part = [(r["item"], words_of(r["text"])) for r in (items.filter(F.col("block") == k) if count > 1 else items).toLocalIterator()]
            if part or count == 1:
                blocks.append(items.sparkSession.sparkContext.broadcast(Queries(sorted(part, key=lambda x: (x[0] is None, x[0] or 0, x[1])), window)))
        if blocks:
            yield blocks


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int):
    """Lists of (doc_id, words) of bounded size."""
    docs, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            docs.append((doc_id.as_py(), words))
            size += len(words) + 1
            if size >= shard_words:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def _stream(docs, vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a shard, a zero after each document; and where each document starts."""
    starts = np.cumsum([0, *(len(words) + 1 for _, words in docs)])
    stream, get = np.zeros(int(starts[-1]), np.int32), vocabulary.get
    for (_, words), at in zip(docs, starts[:-1].tolist(), strict=True):
        stream[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    return stream, starts


def _one_at_a_time(blocks):
    for block in blocks:
        yield block.value
        if len(blocks) > 1:  # a worker keeps no more than one block's value
            block.__dict__.pop("_value", None)


_HITS = "doc_id long, n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, items array<bigint>, longest struct<length:bigint,place:bigint,item_id:bigint,at:bigint>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCH = pa.struct([("length", pa.int64()), ("place", pa.int64()), ("item_id", pa.int64()), ("at", pa.int64())])


def _runs(marked: np.ndarray) -> list[dict]:
    """Maximal runs of marked words, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _in_order(items) -> list:
    return sorted(items, key=lambda x: (x is None, x or 0))


def _longest(matches) -> dict | None:
    """Of matches the longest, of those the first of the document, of one place the smallest item's."""
    return min(matches, key=lambda m: (-m["length"], m["place"], m["item_id"] is None, m["item_id"] or 0, m["at"]), default=None)


def _matches(queries: Queries, stream: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows and which they are → the longest matches there, one that is the rest of another left out: place, length, item (in ``names``) and its first word."""
    size = queries.size[kind]
    full, at = size == queries.window, np.full(len(stream) + 1, -1, np.int64)
    at[place[full]] = kind[full]
    begins = np.sort(place[full])
    before = at[begins - 1]  # before the first word is the last element, -1
    begins = begins[(before < 0) | (queries.successor[before] != at[begins])]
    ends = np.flatnonzero(stream == 0)
    length, found = queries.array.follow(Words(stream, queries.window), begins, ends[np.searchsorted(ends, begins)] - begins, queries.low[at[begins]], queries.high[at[begins]])
    item = np.searchsorted(queries.starts, found, side="right") - 1
    # Of a text shorter than a window the whole is the match.
    short, owner = ~full, queries.suffixes()[0]
    rest = owner[queries.first[kind[short]]]
    return np.concatenate([begins, place[short]]), np.concatenate([length, size[short]]), np.concatenate([item, rest]), np.concatenate([found - queries.starts[item], np.zeros(len(rest), np.int64)])


def _hits(docs, blocks, window: int) -> pa.RecordBatch:
    """What a shard's documents have of the blocks."""
    hit, items, longest = np.zeros(sum(len(words) + 1 for _, words in docs) + 1, np.int64), [set() for _ in docs], [[] for _ in docs]
    starts = np.cumsum([0, *(len(words) + 1 for _, words in docs)])
    for queries in _one_at_a_time(blocks):
        stream, _ = _stream(docs, queries.vocabulary)
        array = SuffixArray(stream, window)
        low, high = array.ranges(queries, queries.first, queries.size)
        counts = high - low
        kind = np.repeat(np.arange(len(counts)), counts)
        if not len(kind):
            continue
        # A place begins one window of each size at most, so these are no more than the shard's words times the sizes of windows.
        place = array.places[np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        met = np.unique(np.stack([np.searchsorted(starts, place, side="right") - 1, kind], axis=1), axis=0)
        for doc, own in met.tolist():
            items[doc].update(queries.names[i] for i in queries.items[(queries.ends[own - 1] if own else 0) : queries.ends[own]])
        place, length, item, at = _matches(queries, stream, place, kind)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + length, -1)
        doc = np.searchsorted(starts, place, side="right") - 1
        best = np.lexsort([place, -length, doc])
        best = best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])]
        for d, n, p, i, a in np.stack([doc, length, place - starts[doc], item, at], axis=1)[best].tolist():
            longest[d].append({"length": n, "place": p, "item_id": queries.names[i], "at": a})
    marked = np.cumsum(hit)[:-1] > 0
    sums = np.concatenate([[0], np.cumsum(marked)])
    n_hit = sums[starts[1:]] - sums[starts[:-1]]
    spans = [_runs(marked[a:b]) if n else [] for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), n_hit.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in docs], pa.int64()), pa.array([len(w) for _, w in docs], pa.int64()), pa.array(n_hit), pa.array(spans, _SPAN), pa.array([_in_order(i) for i in items], pa.list_(pa.int64())), pa.array([_longest(m) for m in longest], _MATCH)],
        ["doc_id", "n_words", "n_hit", "spans", "items", "longest"],
    )


def _finding(blocks, window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _shards(batches, shard_words):
            yield _hits(docs, blocks, window)

    return run


def _uniting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_words, passes: what each pass found) → rows of hits."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            marked = np.zeros(r["n_words"] + 1, bool)
            for span in (span for p in r["passes"] for span in p["spans"]):
                marked[span["start"] : span["end"]] = True
            rows.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": int(marked.sum()), "spans": _runs(marked), "items": _in_order({i for p in r["passes"] for i in p["items"]}), "longest": _longest(p["longest"] for p in r["passes"] if p["longest"])})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.int64())), ("longest", _MATCH)]))


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, id_col: str, item_text_col: str, item_col: str, window: int, shard_words: int, block_words: int, null_items: bool, pass_words: int):
    """The rows of :func:`benchmark_hits` and the broadcasts that they still need."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scope(docs.sparkSession) as scope:
        found, held, numbered, blocks = None, None, None, []
        for blocks in _passes(_items(benchmark, item_text_col, item_col, null_items), window, block_words, pass_words):
            if found is not None and held is None:
                # There is a second pass: rows get numbers, so that what passes find of one row meets again.
                numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
                held = materialize(_pass(numbered, first, window, shard_words), "hits")
                _destroy(first)
            if held is None:
                first, found = blocks, texts.mapInArrow(_finding(blocks, window, shard_words), _HITS)
            else:
                held = held.unionByName(materialize(_pass(numbered, blocks, window, shard_words), "hits"))
                _destroy(blocks)
        if held is not None:
            passes = held.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("spans", "items", "longest")).alias("passes"))
            united = passes.join(numbered.select("row", F.col("doc_id")), "row").select("doc_id", "n_words", "passes")
            found, blocks = scope.keep(materialize(united.mapInArrow(_uniting, _HITS), "united")), []
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))), blocks


def _pass(numbered: DataFrame, blocks, window: int, shard_words: int) -> DataFrame:
    return numbered.select(F.col("row").alias("doc_id"), "text").mapInArrow(_finding(blocks, window, shard_words), _HITS)


def _destroy(blocks) -> None:
    for block in blocks:
        block.destroy()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, null_items: bool = False, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window's occurrence), spans (where: runs of such words, ends exclusive), items (their ids), longest, contaminated.

    ``longest`` is the document's longest verbatim match, null without a hit: its length in words, its first word's place in the document, and
    the item that has it, from its word ``at`` on; of several places the first, of several items that have it one.
    """
    return _found(docs, benchmark, text_col, id_col, item_text_col, item_col, window, shard_words, block_words, null_items, pass_words)[0]


def _matching(blocks, window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _shards(batches, shard_words):
            names = [d for d, _ in docs]
            for queries in _one_at_a_time(blocks):
                stream, starts = _stream(docs, queries.vocabulary)
                length, place = SuffixArray(stream, window, queries.longest).longest(queries)
                keep = np.flatnonzero(length)
                doc = np.searchsorted(starts, place[keep], side="right") - 1
                owner, at, _ = queries.suffixes()
                yield pa.RecordBatch.from_arrays([pa.array([queries.names[i] for i in owner[keep]], pa.int64()), pa.array(at[keep]), pa.array(length[keep]), pa.array([names[d] for d in doc], pa.int64()), pa.array((place[keep] - starts[doc]).astype(np.int64))], ["item_id", "at", "length", "doc_id", "place"])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per benchmark suffix with a match: item_id, at (its first word), length (words, however many), doc_id and place (word) of one such match."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("place")).alias("p"))).alias("best")
    with Scope(docs.sparkSession) as scope:
        found = None
        for blocks in _passes(_items(benchmark, item_text_col, item_col, False), window, block_words, pass_words):
            rows = texts.mapInArrow(_matching(blocks, window, shard_words), "item_id long, at long, length long, doc_id long, place long")
            part = scope.keep(materialize(rows.groupBy("item_id", "at").agg(best), "longest"))  # an item's suffixes are in one pass each
            found = part if found is None else found.unionByName(part)
            _destroy(blocks)
    found = found.groupBy("item_id", "at").agg(F.max("best").alias("best"))  # items that repeat with other texts
    return found.select("item_id", "at", "best.length", (-F.col("best.d")).alias("doc_id"), (-F.col("best.p")).alias("place"))


def hits_digest(hits: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, null_items: bool = False, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; of rows that share an id, all go if one is."""
    with Scope(docs.sparkSession) as scope:
        hits, blocks = _found(docs, benchmark, text_col, id_col, item_text_col, item_col, window, shard_words, block_words, null_items, pass_words)
        bad = scope.keep(materialize(hits.filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated"))
        _destroy(blocks)  # the decisions are written
    return docs.join(small(bad), docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")
