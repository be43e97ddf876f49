"""Token ids as files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A file is a Parquet table of segments.  One segment holds whole documents, in ascending order of their ids, as one binary value:

    magic ``PLH1``, then little-endian unsigned 32-bit: block size, number of tokens, of documents, of blocks
    the number of tokens of each document (unsigned 32-bit each)
    the bit offset at which each block of ``BLOCK`` tokens starts (unsigned 64-bit each): the checkpoints
    the bit stream, most significant bit first, padded with eight zero bytes

The code book is a table beside the segments: the code length of each id; canonical order (length, then id) gives the
codes.  Lengths are limited to ``MAX_BITS`` by the package-merge method, so that one table of 2^MAX_BITS entries decodes
any code.  Since each block starts at a known bit, all blocks of a segment are decoded side by side, one symbol of each
per step.

Counts are summed over all documents.  The documents are range-partitioned by id and sorted, so a partition is a run of
the global order; the number of ids before it follows from the partitions' totals.

Defined results: a null text is the empty text, which has only the end id; null doc_ids come first in the order; rows
that repeat a doc_id are written each, ordered by their numbers of ids, then their ids; columns beside id and text aren't read; an empty table gives
an empty file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playlake.llm.scratch import Scope, materialize, new_path
from playlake.llm.worker import bound_batches, held

MAX_BITS, BLOCK, SEGMENT_TOKENS = 18, 256, 1 << 18
_HEAD = struct.Struct("<4s4I")
#: The characters that byte-level tokenizers have for bytes: visible ones for themselves, those from 256 on for the others.
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
#: The same for all bytes, but the space, which parts words, stays.
_UTF_16 = np.array([b if b == 32 else BYTE_CHARACTERS.get(b, b) for b in range(256)], "<u2")
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_PROBES = [w.encode() for w in ("a", "word", "straße", "éàçñ", "übermäßigkeiten", "дом", "東京", "ħšǫx", "extraordinarinesses")]


# --- code books -----------------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` (package-merge; one symbol alone gets one bit)."""
    if len(counts) > 1 << max_bits:
        raise ValueError("too many ids for this length of codes")
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    ids = np.array(sorted(counts, key=lambda i: (counts[i], i)))
    weights = np.array([counts[i] for i in ids], dtype=np.float64)
    # Each level's list merges the symbols with pairs of the list below; only how many symbols a prefix holds is needed.
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths, take = np.zeros(len(ids), dtype=np.int64), 2 * len(ids) - 2
    for is_symbol in reversed(levels):
        n_symbols = int(is_symbol[:take].sum())
        lengths[:n_symbols] += 1
        take = 2 * (take - n_symbols)
    return dict(zip(ids.tolist(), lengths.tolist(), strict=True))


class Codes:
    """The codes of a book, for encoding and decoding with numpy."""

    def __init__(self, lengths: dict[int, int], max_bits: int = MAX_BITS):
        self.max_bits = max_bits
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.n_bits = np.zeros(max(lengths, default=0) + 1, dtype=np.uint64)
        self.code = np.zeros_like(self.n_bits)
        symbols = np.array(order, dtype=np.uint32)
        widths = np.array([lengths[i] for i in order], dtype=np.uint64)
        # In canonical order, codes aligned to the left are running sums of the space that each takes.
        space = np.uint64(1) << (np.uint64(max_bits) - widths)
        starts = np.concatenate([[np.uint64(0)], np.cumsum(space)[:-1]]).astype(np.uint64) if len(order) else space
        self.n_bits[symbols] = widths
        self.code[symbols] = starts >> (np.uint64(max_bits) - widths)
        self.symbols, self.widths, self.space = symbols, widths, space
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and width for each value of the next ``max_bits`` bits."""
        if self._table is None:
            symbol, width = np.zeros(1 << self.max_bits, np.uint32), np.ones(1 << self.max_bits, np.uint8)
            n = int(self.space.sum())
            symbol[:n], width[:n] = np.repeat(self.symbols, self.space.astype(np.int64)), np.repeat(self.widths.astype(np.uint8), self.space.astype(np.int64))
            self._table = symbol, width
        return self._table

    def encode(self, ids: np.ndarray, doc_tokens: np.ndarray, block: int = BLOCK) -> bytes:
        """One segment."""
        bits = self.n_bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        # A code lies in at most two 32-bit words; words are sums of parts that share no bit, exact in float64.
        word, room = (starts >> np.uint64(5)).astype(np.int64), np.uint64(64) - (starts & np.uint64(31)) - bits
        both = self.code[ids] << room
        size = total // 32 + 2
        words = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), size + 1)[:size] if len(ids) else np.zeros(size)
        stream = words.astype(np.uint32).astype(">u4").tobytes()
        offsets = starts[::block].astype("<u8")
        return _HEAD.pack(b"PLH1", block, len(ids), len(doc_tokens), len(offsets)) + doc_tokens.astype("<u4").tobytes() + offsets.tobytes() + stream + bytes(8)

    def decode(self, segment: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A segment's ids, and the number of each document's."""
        magic, block, n, docs, blocks = _HEAD.unpack_from(segment)
        if magic != b"PLH1":
            raise ValueError("not a segment of this format")
        at = _HEAD.size
        doc_tokens = np.frombuffer(segment, "<u4", docs, at)
        offsets = np.frombuffer(segment, "<u8", blocks, at + 4 * docs).astype(np.int64)
        stream = np.frombuffer(segment, np.uint8, offset=at + 4 * docs + 8 * blocks)
        out = np.zeros((blocks, block), np.uint32)
        symbol, width = self.table()
        # 32 bits from each byte on, so that a position's next bits are one look-up and one shift.
        wide = stream[:-3].astype(np.uint32) << np.uint32(24)
        for k in (1, 2, 3):
            wide |= stream[k : len(stream) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
        if not (self.max_bits <= 25):
            raise ValueError("codes are too long for one look-up")
        last = n - (blocks - 1) * block if blocks else 0
        position, shift, mask = offsets.copy(), 32 - self.max_bits, np.uint32((1 << self.max_bits) - 1)
        for k in range(block if blocks else 0):
            alive = blocks if k < last else blocks - 1
            if not alive:
                break
            p = position[:alive]
            peek = (wide[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[:alive, k] = symbol[peek]
            p += width[peek]
        return out.ravel()[:n], doc_tokens


# --- ids of texts ---------------------------------------------------------------------------------------------------


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Encodes with a tokenizer that drops white space, remembering the ids of pieces of texts.

    Such a tokenizer treats what stands between spaces independently.  Where it also parts words between letters, digits and
    marks, these runs are the pieces, cut and folded for many texts at once; words with anything else are one piece each, as they stand.
    """

    #: Pieces that are remembered, and bytes of texts that are cut at once.
    LIMIT, CHUNK = 150_000, 3 << 19

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether the model alone gives the ids of plain words, from their bytes as the characters of :data:`BYTE_CHARACTERS`.
        self.by_model = bool(suffix) and all(self._plain(w) == self.packed(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids) for w in _PROBES)
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Ids that end a word, by which the ids of many words are told apart.
        self.closing = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab(False).items() if suffix and t.endswith(suffix)]] = True
        #: Tokens that the tokenizer looks for before it changes a text; none has white space.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in self.added):
            raise ValueError("an added token of this tokenizer isn't one word")
        self.folded = [t.lower() for t in self.added]
        self._forget()
        self._learn_classes()

    def _forget(self) -> None:
        #: The place of each known piece; ``flat`` has its ids from ``bounds[place]`` on to the next; whether it was met again.
        self.places: dict[bytes, int] = {}
        self.flat, self.bounds, self.again = np.empty(0, self.kind), np.zeros(1, np.int64), np.zeros(0, bool)

    def _learn_classes(self) -> None:
        """Classes and folded forms of characters of one or two bytes, as the tokenizer has them."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        kinds, folds = np.full(0x800, _ODD, np.uint8), np.arange(0x800)
        for code in [*range(33, 127), *range(0xA0, 0x800)]:
            low = normal(chr(code))
            if len(low) != 1 or code == ord("'") or (code > 127) != (127 < ord(low) < 0x800) or normal(low) != low:
                continue
            if low.isalpha():
                kinds[code], folds[code] = _LETTER, ord(low)
            elif code < 127:
                kinds[code] = _DIGIT if low.isdigit() else _MARK
        kinds[[ord(c) for c in " \t\n\r\x0b\x0c"]] = _SPACE
        self.kinds, self.folds = kinds, folds
        # Where that and the pieces don't give the tokenizer's ids for each character beside others, no word is cut.
        probe = " ".join(w for c in map(chr, range(33, 127)) for w in (c, c + c, f"a{c}", f"{c}a", f"1{c}", f"{c}1", f".{c}", f"{c}.", f"É{c}É"))
        probe += "".join(f" 1{chr(c)}a{chr(c)}." for c in range(0x80, 0x800) if kinds[c] == _LETTER)
        if self.encode([probe])[0] != self.packed([*self.tokenizer.encode(probe, add_special_tokens=False).ids, *([] if self.end_id is None else [self.end_id])]):
            kinds[kinds != _SPACE] = _ODD
        self._forget()

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    @staticmethod
    def is_plain(word: bytes) -> bool:
        """Whether a word has letters only, none of which the tokenizer changes."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode()
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _plain(self, word: bytes) -> bytes:
        """The ids of a word of small letters, which the tokenizer's steps before the model neither change nor split."""
        return self.packed([x.id for x in self.tokenizer.model.tokenize(word.decode("latin-1").translate(BYTE_CHARACTERS))])

    def cut(self, raw: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of texts that begin at ``starts`` of the bytes ``raw``, and where each begins."""
        kind = self.kinds[raw]
        kind[raw > 127] = _ODD
        low = self.folds[:128].astype(np.uint8)[raw & 127]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
        code = (raw[lead].astype(np.int64) & 31) << 6 | raw[lead + 1] & 63
        kind[lead] = kind[lead + 1] = self.kinds[code]
        low[lead], low[lead + 1] = 0xC0 | self.folds[code] >> 6, 0x80 | self.folds[code] & 63
        text = raw.tobytes().lower()
        if any(t in text for t in self.folded):
            kind[np.isin(raw, [t[0] for t in self.added])] = _ODD
        solid, first = kind != _SPACE, np.zeros(len(raw) + 1, bool)
        first[0] = first[starts] = True
        first = first[:-1]
        begins = first | (kind == _DIGIT)
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= solid
        if (kind == _ODD).any():
            words = first.copy()
            words[1:] |= ~solid[:-1]
            words &= solid
            number = np.cumsum(words, dtype=np.int32) - 1
            odd = np.zeros(number[-1] + 1, bool)
            odd[number[kind == _ODD]] = True
            whole = odd[number] & solid
            begins = np.where(whole, words, begins)
            low = np.where(whole, raw, low)
        at = np.flatnonzero(begins)
        offsets = np.append(np.cumsum(solid, dtype=np.int32)[at] - 1, np.count_nonzero(solid)).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])]), at

    def learn(self, pieces: list[bytes]) -> None:
        """Give places to pieces that aren't known, which are encoded many in one call."""
        plain = [p for p in pieces if self.is_plain(p)] if self.by_model else []
        flat, sizes, order = [self.flat], [], []
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.model_only.encode_batch_fast([_UTF_16[np.frombuffer(b" ".join(part), np.uint8)].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
                order += part
        rest = list(set(pieces).difference(order))
        for at in range(0, len(rest), 4096):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in rest[at : at + 4096]], add_special_tokens=False)
            flat += [np.array(x.ids, self.kind) for x in found]
            sizes.append(np.array([len(x.ids) for x in found]))
        n = len(self.places)
        self.places.update(zip(order + rest, range(n, n + len(pieces)), strict=True))
        self.flat = np.concatenate(flat)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def _make_room(self) -> None:
        """Keep what was met again since there was room last, if that is little enough, else nothing."""
        keep = np.flatnonzero(self.again)
        starts, sizes = self.bounds[keep], self.bounds[keep + 1] - self.bounds[keep]
        if 4 * len(keep) > 3 * self.LIMIT or sizes.sum() > 4 * self.LIMIT:
            return self._forget()
        pieces = list(self.places)
        self.places = {pieces[k]: place for place, k in enumerate(keep.tolist())}
        self.flat, self.bounds, self.again = _runs(self.flat, starts, sizes), np.append(0, np.cumsum(sizes)), np.zeros(len(keep), bool)

    def _encode_chunk(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces in order; of each piece where it begins and how many ids it has."""
        if len(self.places) > self.LIMIT or len(self.flat) > 8 * self.LIMIT:
            self._make_room()
        pieces, at = self.cut(raw, starts)
        if not len(at):
            return self.flat[:0], at, at
        coded = pieces.dictionary_encode()
        data, ends = coded.dictionary.buffers()[2].to_pybytes(), np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
        distinct = [data[a:b] for a, b in pairwise(ends)]
        places = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        self.again[places[places >= 0]] = True
        if len(new):
            pieces = [distinct[k] for k in new.tolist()]
            self.learn(pieces)
            places[new] = [self.places[p] for p in pieces]
        place = places[coded.indices.to_numpy()]
        sizes = self.bounds[place + 1] - self.bounds[place]
        return _runs(self.flat, self.bounds[place], sizes), at, sizes

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        counts, found, low = np.zeros(len(texts), np.int64), [np.empty(0, self.kind)], 0
        while low < len(raw):
            high = self._chunk_end(raw, offsets, low)
            ids, at, sizes = self._encode_chunk(raw[low:high], offsets[(offsets > low) & (offsets < high)] - low)
            found.append(ids)
            counts += np.bincount(np.searchsorted(offsets, at + low, "right") - 1, sizes, len(texts)).astype(np.int64)
            low = high
        ids = np.concatenate(found)
        if self.end_id is None:
            return ids, counts
        ends = np.cumsum(counts + 1) - 1
        all_ids, inner = np.full(len(ids) + len(texts), self.end_id, self.kind), np.ones(len(ids) + len(texts), bool)
        inner[ends] = False
        all_ids[inner] = ids
        return all_ids, counts + 1

    def _chunk_end(self, raw: np.ndarray, offsets: np.ndarray, low: int) -> int:
        """The last end of a text within a chunk's bytes; of a longer text the next white space."""
        high = int(offsets[np.searchsorted(offsets, low + self.CHUNK, "right") - 1])
        if high > low:
            return high
        end = int(offsets[np.searchsorted(offsets, low, "right")])
        for at in range(low + self.CHUNK, end, self.CHUNK):
            spaces = np.flatnonzero(self.kinds[raw[at : min(at + self.CHUNK, end)] & 127] == _SPACE)
            spaces = spaces[raw[at + spaces] < 128]
            if len(spaces):
                return at + int(spaces[0])
        return end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, as numbers of :attr:`kind`."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches made into ones of at most ``limit`` bytes, so that what their rows share is looked up once."""
    held_back, size = [], 0
    for batch in batches:
        if held_back and size + batch.nbytes > limit:
            yield pa.concat_batches(held_back)
            held_back, size = [], 0
        held_back.append(batch)
        size += batch.nbytes
    if held_back:
        yield pa.concat_batches(held_back)


def _encoding(path: str, end_id: int | None, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held((path, end_id), lambda: WordEncoder(path, end_id))
        names, total = ["doc_id", "n_tokens", "ids", *["counts"] * counted], np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64)
        for part in _joined(batches, encoder.CHUNK):
            ids, n = encoder.encode_column(part.column("text"))
            offsets = np.append(0, np.cumsum(n)) * encoder.kind.itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), packed]
            if counted:
                met = np.bincount(ids)
                total = np.concatenate([total, np.zeros(max(0, len(met) - len(total)), np.int64)])
                total[: len(met)] += met
                columns.append(pa.nulls(part.num_rows, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)
        if counted and total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return run


def _unpacked(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32)


def _summed(arrays: Iterator[np.ndarray]) -> pa.RecordBatch:
    """Rows (id, n) of the sum of counts by id."""
    total = np.zeros(0, np.int64)
    for found in arrays:
        if len(found) > len(total):
            total, found = found.copy(), total
        total[: len(found)] += found
    seen = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _summed(np.bincount(_unpacked(n, ids.as_py())) for batch in batches for n, ids in zip(batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True))


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _summed(np.frombuffer(counts.as_py(), np.int64) for batch in batches for counts in batch.column("counts"))


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (16 or 32 bits each)."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_encoding(tokenizer_path, end_id, False), "doc_id long, n_tokens long, ids binary")


def counted_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`token_ids`, written, and (id, n): how often each id is among them, from the same pass."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # A task's counts are the last row of its output, in a column of their own; reading them doesn't touch the ids.
    both = materialize(texts.mapInArrow(_encoding(tokenizer_path, end_id, True), "doc_id long, n_tokens long, ids binary, counts binary"), "tokens")
    counts = both.filter("counts is not null").select("counts").mapInArrow(_adding, "id long, n long")
    return both.filter("n_tokens is not null").drop("counts"), counts.groupBy("id").agg(F.sum("n").alias("n"))


# --- files ----------------------------------------------------------------------------------------------------------

_SEGMENT = "part int, place int, n_tokens long, doc_ids array<bigint>, segment binary"


def _packing(lengths: dict[int, int], segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, place = Codes(lengths), TaskContext.get().partitionId(), 0
        names, runs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            segment = codes.encode(np.concatenate(runs), np.array([len(r) for r in runs], np.uint32))
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "n_tokens": size, "doc_ids": names, "segment": segment}], schema=pa.schema([("part", pa.int32()), ("place", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())]))

        for batch in batches:
            for doc_id, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                names.append(doc_id)
                runs.append(_unpacked(n, ids.as_py()))
                size += n
                if size >= segment_tokens:
                    yield flush()
                    names, runs, size, place = [], [], 0, place + 1
        if names:
            yield flush()

    return run


def write_ids(ids: DataFrame, path: str, segment_tokens: int = SEGMENT_TOKENS, counts: DataFrame | None = None) -> None:
    """Write (doc_id, n_tokens, ids) as files below ``path``: ``segments`` and ``book``.

    ``counts`` has (id, n) of all ids, if known.  ``ids`` is read more than once; give a written table.
    """
    spark = ids.sparkSession
    if counts is None:
        counts = ids.select("n_tokens", "ids").mapInArrow(_counting, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in counts.collect()}  # one row per id of the vocabulary: bounded by it, whatever the corpus
    lengths = code_lengths(counts)
    spark.createDataFrame(list(lengths.items()), "id long, n_bits int").coalesce(1).write.parquet(f"{path}/book")
    # Rows that share an id, or have none, are dealt out by their lengths too.
    ordered = ids.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(_packing(lengths, segment_tokens), _SEGMENT).write.parquet(f"{path}/segments")


def _reading(lengths: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        for batch in batches:
            for part, place, names, segment in zip(batch.column("part"), batch.column("place"), batch.column("doc_ids"), batch.column("segment"), strict=True):
                ids, sizes = codes.decode(segment.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n_docs = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n_docs, pa.int32()), pa.array([place.as_py()] * n_docs, pa.int32()), names.values, pa.array(ends - sizes), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())], ["part", "place", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian, 32 bits each)."""
    lengths = {r["id"]: r["n_bits"] for r in spark.read.schema("id long, n_bits int").parquet(f"{path}/book").collect()}  # bounded by the vocabulary
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    # A row per segment of some hundred thousand tokens: what is before a part comes from the parts' totals, one row each.
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, bases = 0, []
    for part, n in totals:
        bases.append((part, before))
        before += n
    bases = spark.createDataFrame(bases, "part int, base long")
    earlier = segments.select("part", "place", "n_tokens").withColumn("earlier", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens"))
    starts = materialize(earlier.join(bases, "part").select("part", "place", (F.col("base") + F.col("earlier")).alias("start")), "starts")
    docs = segments.select("part", "place", "doc_ids", "segment").mapInArrow(_reading(lengths), "part int, place int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    found = docs.join(starts, ["part", "place"]).select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return found if with_ids else found.drop("ids")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    with Scope(spark):
        ids, counts = counted_ids(docs, tokenizer_path, end_id, text_col, id_col)
        write_ids(ids, path, counts=counts)
    return read_ids(spark, path, with_ids=False)
