"""Token ids of texts that are cut in pieces for many rows at once, against the tokenizers library."""

import numpy as np
import pyarrow as pa
import pytest

from playlake.llm import huffman, queries

pytest.importorskip("public_tokenizers")
PARTS = [
    *"aZ.,;|-_<>'\"#$(0123", "the", "Word", "'s", "'LL", "don't", "ß", "É", "è", "×", "÷", "ÿ", "Ÿ", "ſ", "İ", "ı", "Σ", "σ", "ς", "Ж", "д", "ё", "Ё", "א", "ע", "ا", "آ", "٣", "ª", "µ", "º", "²", "½", "«", "…", "—", "東", "각", "ᄀ", "ᅡ",
    "́", "̈", "ः", "😀", "‍", "K", "Å", "ﬁ", "﻿", "\x00", "\x1c", "\x7f", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def new_encoder(end_id=2):
    return huffman.WordEncoder(queries.tokenizer_path(), end_id)


def check(encoder, tokenizer, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], repr(text)[:200]


def test_new_words_are_encoded_many_in_one_call(tokenizer, monkeypatch):
    """Before, each new word was a call of its own, and so was each that was only followed by other marks."""
    encoder, calls = new_encoder(), []
    monkeypatch.setattr(encoder, "_plain", lambda word: calls.append(word) or huffman.WordEncoder._plain(encoder, word))
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeéüñд"), 9)) for _ in range(6000)]
    check(encoder, tokenizer, [" ".join(words[k : k + 300]) for k in range(0, 6000, 300)])
    assert not calls
    known = len(encoder.places)
    check(encoder, tokenizer, [" ".join(f"({w.upper()}," for w in words)])
    assert len(encoder.places) <= known + 2


def test_pieces_of_odd_texts(tokenizer):
    encoder, rng = new_encoder(), np.random.default_rng(5)
    assert (encoder.kinds == 1).sum() > 1000  # words are cut, not taken whole
    for blanks in (0, 3, 12):
        check(encoder, tokenizer, ["".join(rng.choice([*PARTS, *" \n\t" * blanks], rng.integers(0, 40))) for _ in range(1500)])
    check(encoder, tokenizer, [None, "", " ", "\n\n", "a", None])
    assert encoder.encode([]) == [] and encoder.encode([None, " "]) == [encoder.packed([2])] * 2
    check(new_encoder(), tokenizer, [" ", None])


def test_every_character_beside_others(tokenizer):
    check(new_encoder(), tokenizer, [f"a{chr(c)}b {chr(c)} .{chr(c)}. {chr(c)}{chr(c)}1" for c in range(0x3200) if not 0xD800 <= c < 0xE000])


def test_long_texts_are_cut_between_words_and_room_is_made(tokenizer):
    rng = np.random.default_rng(6)
    encoder = new_encoder()
    encoder.CHUNK, encoder.LIMIT = 200, 150
    words = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 600)).tolist() + ["x" * 700] * (k % 5 == 0)) for k in range(60)]
    check(encoder, tokenizer, texts)
    check(encoder, tokenizer, ["é" * 1000 + "　" * 500, "x" * 199 + " " + "東" * 300, " " * 1000])
    assert len(encoder.places) < 1000


def test_slices_of_columns(tokenizer):
    column = pa.array(["no", "one two", None, "", "three.", "four"]).slice(1, 4)
    for texts in (column, column.cast(pa.large_string())):
        ids, counts = new_encoder(None).encode_column(texts)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_tokenizers_with_other_pieces(tmp_path):
    """One that keeps capitals and doesn't part words: they are taken whole."""
    import json

    from tokenizers import Tokenizer

    with open(queries.tokenizer_path()) as f:
        made = json.load(f)
    made["normalizer"] = None
    made["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(made))
    encoder, rng = huffman.WordEncoder(str(path), 2), np.random.default_rng(7)
    assert not (encoder.kinds == 1).any()
    check(encoder, Tokenizer.from_file(str(path)), ["".join(rng.choice([*PARTS, " "], 30)) for _ in range(500)])


def test_texts_without_ids(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, huffman.token_ids(df, queries.tokenizer_path(), None).collect())) == [(1, 0, b""), (2, 0, b"")]
