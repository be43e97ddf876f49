"""Byte-pair encoding and decoding with a public byte-level vocabulary, as the tokenizers library does it.

A text falls into words by the vocabulary's pattern.  Within a word, encoding holds two contiguous arrays: the boundaries of the
parts (at first, every byte is one) and the merge ranks of adjacent parts.  It scans for the least rank, leftmost first, deletes the boundary
between the two parts, and looks up the ranks of the new part with its neighbours, until no adjacent parts have a rank.  Each scan is as
long as the word, so words above :data:`LONG` bytes (which prose doesn't have) take the same merges in the same order from a heap.

New words of a length are merged side by side.  A worker remembers the ids of the words it met lately, in two generations of a fixed size.

Defined results: a null text is the empty text, which has no ids; ids of documents may be of any type, null or repeated, since rows are treated one by one;
ids without a token are left out in decoding, null lists of ids decode to the empty text; bytes that aren't UTF-8 decode to U+FFFD; columns
that aren't asked for aren't read; an empty table gives an empty one.  A text is encoded by some hundred thousand words at a time, so its length is bounded
by its ids alone.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from playlake.llm.worker import bound_batches, held

#: Bytes of a word from which a heap finds the least rank.
LONG = 256
NONE = 1 << 40
# The public pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of each of the two generations that a worker remembers.
KNOWN = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one above 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Ranks of pairs of parts (by their ids), and the merging of words."""

    def __init__(self, pairs: list[tuple[int, int, int]], byte_ids: np.ndarray):
        #: Pairs in the order of their ranks: left id, right id, id of both together.
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, NONE)
        self.made, self.byte_ids = table[:, 2].astype(np.int32), byte_ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, :data:`NONE` where it isn't merged."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.order[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            groups[len(word)].append(k)
        for n, group in groups.items():
            if n > LONG:
                for k in group:
                    out[k] = self.heaped(words[k])
            elif n:
                for k, ids in self.scanned([words[k] for k in group], n):
                    out[group[k]] = ids
        return out

    def scanned(self, words: list[bytes], n: int) -> Iterator[tuple[int, bytes]]:
        """Words of ``n`` bytes side by side: each step deletes one boundary of every word that has a pair left, so all that go on have as many parts."""
        rows = np.arange(len(words))
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] > 1:
                at = ranks.argmin(axis=1)  # the leftmost of the least
                least = ranks[np.arange(len(rows)), at]
                merged = least < NONE
            else:
                merged = np.zeros(len(rows), bool)
            width, raw = 4 * parts.shape[1], parts[~merged].astype("<i4").tobytes()
            yield from ((k, raw[i * width : (i + 1) * width]) for i, k in enumerate(rows[~merged].tolist()))
            if not merged.any():
                return
            rows, parts, ranks, at, least = rows[merged], parts[merged], ranks[merged], at[merged], least[merged]
            every, left = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, left + (left > at[:, None]), axis=1)
            parts[every, at] = self.made[least]
            left = left[:-1]
            ranks = np.take_along_axis(ranks, left + (left >= at[:, None]), axis=1)
            for where, first in ((at > 0, at - 1), (at < len(left), at)):  # the pairs that the new part ends and begins
                i, f = every[where], first[where]
                ranks[i, f] = self.ranks(parts[i, f], parts[i, f + 1])

    def heaped(self, word: bytes) -> bytes:
        """The same merges of a long word, the least rank from a heap and the parts as a linked list."""
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        known: dict[tuple[int, int], int] = {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte: where the next part begins, and the one before
        ranks = [*self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist(), NONE]
        heap = [(r, k) for k, r in enumerate(ranks) if r < NONE]
        heapq.heapify(heap)

        def refresh(at: int) -> None:
            ranks[at] = NONE
            if after[at] < n:
                pair = ids[at], ids[after[at]]
                if pair not in known:
                    known[pair] = int(self.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
                ranks[at] = known[pair]
            if ranks[at] < NONE:
                heapq.heappush(heap, (ranks[at], at))

        while heap:
            least, at = heapq.heappop(heap)
            if ranks[at] != least:
                continue  # merged or refreshed since
            gone = after[at]
            ids[at], after[at], ranks[gone] = int(self.made[least]), after[gone], NONE
            if after[at] < n:
                before[after[at]] = at
            refresh(at)
            if before[at] >= 0:
                refresh(before[at])
        at, out = 0, []
        while at < n:
            out.append(ids[at])
            at = after[at]
        return np.array(out, "<i4").tobytes()


class Vocabulary:
    """A byte-level vocabulary of the tokenizers library's format: encodes texts and decodes ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        # Only classes of characters are asked of the library: which letters and digits there are differs with the year of its tables.
        self.library = Tokenizer.from_file(path).pre_tokenizer
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or need word limits aren't supported")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = {token: i for token, i in model["vocab"].items() if token not in self.added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        by_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in pairs], by_byte)
        self.tokens = [b""] * (max([*ids.values(), *self.added.values()], default=-1) + 1)
        for token, i in [*((raw(t), i) for t, i in ids.items()), *((t.encode(), i) for t, i in self.added.items())]:
            self.tokens[i] = token
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: Packed ids of the words met lately, and of those before; what is met again moves up, what isn't goes with its generation.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.alike: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def learn(self, words: set[str]) -> None:
        """Let :attr:`known` have all of ``words``."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > KNOWN:
            self.older, self.known, new = self.known, {}, words
        met = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in met)
        rest = list(new - met)
        self.known.update(zip(rest, self.merges.merge([w.encode() for w in rest]), strict=True))

    def _classes(self, letters: set[str]) -> None:
        """Compare the library's class of characters never met before with the pattern's; those that differ get a stand-in of the library's class."""
        for c in letters:
            kind = next((k for k in "x1!" if len(self.library.pre_tokenize_str(k + c)) == 1), "\t")
            mine = next((k for k in "x1!" if len(PATTERN.findall(k + c)) == 1), "\t")
            if kind != mine:
                self.stand_ins[ord(c)] = kind
        self.alike |= letters

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, many at a time."""
        if not text.isascii() and (new := set(text) - self.alike):
            self._classes(new)
        if self.stand_ins and not text.isascii() and (seen := text.translate(self.stand_ins)) != text:
            found = (text[m.start() : m.end()] for m in PATTERN.finditer(seen))
        elif len(text) <= 1 << 20:
            yield PATTERN.findall(text)
            return
        else:
            found = (m[0] for m in PATTERN.finditer(text))
        while part := list(islice(found, 100_000)):
            yield part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of added tokens are these tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list[bytes], list[str]]] = []
        n_waiting = 0

        def flush() -> None:
            self.learn(set().union(*(words for _, words in waiting)))
            for found, words in waiting:
                found.append(b"".join(map(self.known.__getitem__, words)))
            waiting.clear()

        for text, found in zip(texts, out, strict=True):
            for part in self.cut.split(text) if self.cut else [text]:
                if part in self.added:
                    waiting.append((found, [part]))
                    self.known[part] = np.array([self.added[part]], "<i4").tobytes()
                    continue
                for words in self.words(part):
                    waiting.append((found, words))
                    n_waiting += len(words)
                    if n_waiting > 200_000:
                        flush()
                        n_waiting = 0
        flush()
        return [np.frombuffer(b"".join(found), "<i4") for found in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held(("bpe", path), lambda: Vocabulary(path))
        for batch in batches:
            found = vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found) if found else np.zeros(0, "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], [batch.schema.names[0], "n_tokens", "ids"])

    return run


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held(("bpe", path), lambda: Vocabulary(path))
        for batch in batches:
            *kept, lists = batch.columns
            texts = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) else np.zeros(0, np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``n_tokens`` and ``ids``, an array of integers."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = T.StructType([texts.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(_encoding(path), schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The table with the text of its ids, ``decoded``, in their place."""
    bound_batches(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != ids_col]
    ordered = encoded.select(*rest, F.col(ids_col).cast("array<int>"))
    schema = T.StructType([*ordered.schema.fields[:-1], T.StructField("decoded", T.StringType())])
    return ordered.mapInArrow(_decoding(path), schema)


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    ids = encode(docs, path).select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
