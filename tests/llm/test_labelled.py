"""Classifiers learn from all labelled rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlake.llm import labelled, scratch
from playlake.llm import toxicity as toxicity_module
from playlake.llm.quality import quality
from playlake.llm.toxicity import toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrstv"]


@pytest.mark.parametrize(("operator", "column", "modulus", "rest"), [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_long_texts_are_learnt_from(spark, monkeypatch, operator, column, modulus, rest):
    """All learnt texts of label 1 are longer than a sample's longest; rows fall into several segments."""
    monkeypatch.setattr(labelled, "SEGMENT_ROWS", 30)
    rng, rows, marks = np.random.default_rng(8), [], []
    for k in range(150):
        y = int(k % 5 == 0)
        long = y and zlib.crc32(str(k).encode()) % modulus != rest
        words = list(rng.choice(WORDS, 60)) + ["vile", "vilest"] * 15 * y
        rows.append((k, " ".join(words * (600 if long else 1)), "en"))
        marks.append((k, y, y))
        assert (len(rows[-1][1]) > labelled.SAMPLE_TEXT_CHARS) == bool(long)
    found = operator(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in found if r["held_out"]]
    good, bad = (np.array([r["score"] for r in held if (r["doc_id"] % 5 == 0) == y]) for y in (True, False))
    assert len(good) > 3 and (good[:, None] > bad).mean() > 0.95


def test_every_labelled_row_is_in_one_segment(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SEGMENT_ROWS", 700)
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 50").withColumn("text", F.concat(F.lit("a"), "text")))
    labels = spark.range(6800).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    with scratch.Scope(spark):
        found = labelled.learning_rows(docs, labels, "toxic", F.lit(True))
        rows = found.collect()
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in rows) == [(k, f"at{k}" if k < 50 else f"t{k}", k % 2) for k in range(6800)]
    assert set(Counter(r["segment"] for r in rows)) == set(range(10))


def test_one_round_averages_segments(spark):
    """A row of a table changes by the mean over the segments that changed it."""
    rows = spark.createDataFrame([(s, "x" * (s + 1), 1) for s in range(4)], "segment long, text string, y int").repartition(3)
    state = {"a": np.zeros((40_000, 2), np.float32), "b": np.ones((1, 3), np.float32)}

    def learn(state, segment, texts, y):
        n = sum(map(len, texts))
        state["a"][[n, 39_999]] += n
        state["b"][0, 2] += n

    labelled.learn_round(rows, state, learn)
    want = np.zeros((40_000, 2), np.float32)
    want[[1, 2, 3, 4]], want[39_999] = [[1, 1], [2, 2], [3, 3], [4, 4]], 2.5
    assert np.allclose(state["a"], want) and np.allclose(state["b"], [[1, 1, 3.5]])


def test_counts_of_features():
    seen = toxicity_module.texts_with(["vile vile viler", "vile", ""])
    of = toxicity_module.features(b"vile")
    assert [seen[of[0]], seen[toxicity_module.features(b"viler")[0]]] == [2, 1] and seen[of[1]] == 0 or of[1] == 0


def test_thresholds_have_the_best_f1():
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.3).astype(float)
    scores = np.clip(0.3 * y + 0.6 * rng.random(300), 0, 1)
    tried = toxicity_module._TRIED
    reached = (scores[:, None] >= tried).sum(axis=1)
    f1 = np.array([2 * ((scores >= t) & (y > 0)).sum() / ((scores >= t).sum() + y.sum()) for t in tried])
    n, toxic = np.bincount(reached, minlength=len(tried) + 1), np.bincount(reached, y, len(tried) + 1)
    assert toxicity_module._best(n, toxic) == round(float(tried[np.isclose(f1, f1.max())].mean()), 3)


def test_plain_words_get_the_ids_of_the_whole_tokenizer():
    """By the model alone, without the tokenizer's other steps, also where letters aren't ASCII."""
    from playlake.llm import huffman, queries

    encoder = huffman.WordEncoder(queries.tokenizer_path(), 2)
    rng = np.random.default_rng(2)
    letters = [c for c in map(chr, [*range(97, 123), *range(0xDF, 0x250), *range(0x3B1, 0x3CA), *range(0x430, 0x450), *range(0x4E00, 0x4E40)]) if encoder.is_plain(c.encode())]
    words = ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000)]
    assert encoder.by_model and all(encoder.is_plain(w.encode()) for w in words if w.isascii())
    plain = [w for w in words if encoder.is_plain(w.encode())]
    assert len(plain) > 2000 and all(encoder._plain(w.encode()) == encoder.packed(x.ids) for w, x in zip(plain, encoder.tokenizer.encode_batch(plain, add_special_tokens=False), strict=True))
