"""The registered queries of ``playlake.llm`` and the pipeline, on the smallest tables."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from playlake.llm import labelled, scratch, worker
from playlake.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op4_quality", "quality")])
def test_held_out(spark, name, label):
    """The rows that weren't learnt from are ranked nearly right."""
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").filter(f"{label} is not null").collect()}
    held = [r for r in QUERIES[name](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    y, scores = np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    better = (scores[y > 0][:, None] > scores[y == 0]).mean() + 0.5 * (scores[y > 0][:, None] == scores[y == 0]).mean()
    assert better > 0.9


def test_pipeline(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        sizes.append(docs.count())
        docs = stage(spark, docs, DATA)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == first.columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and docs.count() == sizes[4]
    whole = corpus_pipeline.run(spark, DATA)
    assert Counter(whole.collect()) == Counter(docs.collect())
    ordered = sorted(whole.collect(), key=lambda r: r["start"])
    ends = np.cumsum([0, *(r["n_tokens"] for r in ordered)])
    assert [r["start"] for r in ordered] == ends[:-1].tolist() and zlib.crc32(b"") not in {r["ids_crc32"] for r in ordered}


def odd_documents():
    """Null, empty and repeated texts, near copies, a passage of the benchmark, null sources, repeated and missing ids, a very long text."""
    rng = np.random.default_rng(21)
    words = [f"q{k}" for k in range(900)]
    draw = lambda n: " ".join(rng.choice(words, n))
    passage, base = draw(16), draw(80)
    texts = [None, "", "  ", "one", base, base, f"{base} more", base.upper(), f"see {passage} there", draw(9000), draw(60), draw(70), "end.", draw(5), draw(5)]
    texts += [draw(int(rng.integers(1, 60))) for _ in range(40)]
    rows = [(k, t, ["en", None, "de"][k % 3], ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (3, "one", "en", "a", 3), (None, draw(30), None, "b", 1)], [(1, passage), (2, None), (None, ""), (3, passage)]


def written(spark, folder, documents, benchmark, labels=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def near_kept(documents):
    def shingles(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets, label = [shingles(d[1]) for d in documents], list(range(len(documents)))
    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]) and label[a] != label[b]:
                label = [label[b] if k == label[a] else k for k in label]
    kept = []
    for k, d in enumerate(documents):
        ids = [o[0] for o, n in zip(documents, label, strict=True) if n == label[k] and o[0] is not None] if sets[k] else [d[0]]
        kept.append(d[0] == min(ids, default=None))
    ids = {d[0] for d, keep in zip(documents, kept, strict=True) if keep}
    return [d for d in documents if d[0] in ids]


def clean(documents, benchmark):
    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {tuple(w[i : i + 13]) for _, t in benchmark if (w := words_of(t)) for i in range(max(1, len(w) - 12))}
    out = []
    for d in documents:
        words, hit = words_of(d[1]), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not (hit and 20 * len(hit) >= len(words)):
            out.append(d)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages over odd rows; no label is toxic, so the first stage keeps everything and the rest can be counted out."""
    from tokenizers import Tokenizer

    documents, benchmark = odd_documents()
    folder = written(spark, tmp_path, documents, benchmark, [(k, 1, 0) for k in range(20)])
    near = near_kept(documents)
    left = clean(near, benchmark)
    assert len(documents) > len(near) > len(left) and 8 not in {d[0] for d in left}
    con = duckdb.connect()
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    con.register("documents", pa.table({c: [d[k] for d in left] for k, c in enumerate(columns)}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op9_hash_mixing']})").fetchall()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    copies = {(i, n): t // n for i, n, t in taken if n}
    got = corpus_pipeline.run(spark, folder).collect()
    want = Counter()
    for doc_id, text, *_ in left:
        size = len((text or "").split())
        if size:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
            want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += copies[doc_id, size]
    empty = zlib.crc32(np.array([2], "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["ids_crc32"] != empty) == +want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in ordered), key=lambda i: (i is not None, i or 0))


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


def test_sample_is_the_same_whatever_the_order(spark, tmp_path):
    rows = [(k % 40, f"text {k}", "en", "a", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = [[tuple(r) for r in labelled.sample(spark.createDataFrame(part, schema).repartition(n), labels, "toxic", F.col("doc_id") % 2 == 0, ("lang",), 15)] for part, n in ((rows, 2), (rows[::-1], 7))]
    assert found[0] == found[1] and len(found[0]) == 15 and len({r[1] for r in found[0]}) == 15


def test_scopes_delete_what_they_do_not_keep(spark):
    df = spark.range(3)
    with scratch.Scope(spark) as outer:
        with scratch.Scope(spark) as inner:
            kept, gone = scratch.materialize(df, "kept"), scratch.materialize(df, "gone")
            inner.keep(kept)
        assert kept.count() == 3 and not os.path.exists(gone.scratch_path.removeprefix("file://"))
        assert outer.paths == [kept.scratch_path]
    assert not os.path.exists(kept.scratch_path.removeprefix("file://")) and not scratch._SCOPES
    with pytest.raises(ZeroDivisionError), scratch.Scope(spark):
        lost = scratch.materialize(df, "lost")
        1 / 0
    assert not os.path.exists(lost.scratch_path.removeprefix("file://")) and not scratch._SCOPES


def test_settings_are_taken_back(spark):
    names = list(worker._BOUNDS)
    before = {n: spark.conf.get(n, None) for n in names}
    worker.release(spark)
    spark.conf.set(names[0], "77")
    worker.bound_batches(spark)
    assert spark.conf.get(names[0]) == "77" and spark.conf.get(names[2], None) == str(worker._BOUNDS[names[2]])
    worker.release(spark)
    assert spark.conf.get(names[0]) == "77" and all(spark.conf.get(n, None) is None for n in names[1:])
    spark.conf.unset(names[0])
    for n, value in before.items():
        if value is not None:
            spark.conf.set(n, value)


def test_workers_remember_one_object():
    assert worker.held("a", list) is worker.held("a", list)
    first = worker.held("a", list)
    worker.held("b", dict)
    assert worker.held("a", list) is not first
