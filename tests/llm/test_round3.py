"""Resampling, byte-pair encoding and conversation repair against brute force, the library, and odd tables."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playlake.llm import bpe, repair as repair_module, resample as resample_module
from playlake.llm.queries import ORACLE_SQL
from playlake.llm.repair import Automaton, damaged, repair, repaired_rows
from playlake.llm.repair_sql import REPAIR_SQL
from playlake.llm.resample import draw, importance, resample

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "block long, bucket int, n long, rank long, part int, place long, kinds binary, key string, ids string, copy int, gone_too boolean"
WORDS = [f"w{k}" for k in range(300)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- resampling -----------------------------------------------------------------------------------------------------


def odd_texts():
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [None, "", " .,;", "One two", "É naïve 東京 x_y İ ſ K", "a" * 5000, words(30_000), "the " * 70_000, words(25), words(25).upper()]
    return texts + [words(int(rng.integers(1, 60))) for _ in range(60)]


def features_of(text, runs=1):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    of = lambda text: [zlib.crc32(f.encode()) % buckets for f in features_of(text, runs)]
    found = [(i, of(t)) for i, t in docs]
    s, t = Counter(b for _, x in found for b in x), Counter(b for x in target for b in of(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, x in found:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for rank, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("runs", "buckets", "percent", "block"), [(1, 10_000, 10, 4096), (3, 50, 60, 7), (2, 1, 100, 4096)])
def test_resampling(spark, runs, buckets, percent, block):
    """All words in one bucket, blocks of a few documents, repeated and missing ids."""
    docs = [(k, t) for k, t in enumerate(odd_texts())]
    docs += [docs[8], (8, docs[9][1] + " more"), (None, docs[8][1]), (None, None)]
    target = [docs[8][1], docs[12][1], None, "", "unseen words here"]
    df = spark.createDataFrame([(i, t, *[None] * 11) for i, t in docs], f"doc_id long, text string, {EXTRA}").repartition(3)
    wanted = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = draw(importance(df, wanted, runs, buckets, block_docs=block), percent) if block == 7 else resample(df, wanted, runs, buckets, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got, *got.columns) == drawn(docs, target, runs, buckets, percent)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs).count() == 0 and resample(none, none).count() == 0
    assert rows_of(resample(docs, none, least_features=0, percent=50), "doc_id", "n_features", "weight", "score", "rank") == drawn([(1, "a b"), (2, None)], [], least=0, percent=50)
    assert importance(docs, none).count() == 2


def test_pieces_hold_whole_words(monkeypatch):
    for piece in (1, 5, 1000):
        monkeypatch.setattr(resample_module, "PIECE", piece)
        for text in ("", "x", "Aa bb,cc  dd", "é " * 40, "long" * 50 + " end"):
            assert sorted(f.decode() for part in resample_module.features(text, 3) for f in part) == sorted(features_of(text, 3))


# --- byte pairs -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def odd_strings():
    rng = random.Random(3)
    out = [None, "", " ", "   ", "\n\n a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftex", "it's WE'LL 'tis ''s", "x" * 4000, " " * 700 + "y", "ab" * 900, "\u0085\x1c\x1d　 ​", "\U00010940՘ x", "é" * 300]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x10000, 0x2FFFF)])) for _ in range(40)) for _ in range(150)]
    return out + ["".join(rng.choice(["the", " the", " ", "\t", "ing", "9", "²", "'s", "日本", "!?", "\U00010940"]) for _ in range(60)) for _ in range(100)]


def test_bpe_is_the_librarys(spark, library):
    texts = odd_strings()
    df = spark.createDataFrame([(k % 50 or None, t, *[None] * 11) for k, t in enumerate(texts)], f"doc_id long, text string, {EXTRA}").repartition(3)
    got = bpe.round_trip_digest(df, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k % 50 or None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(got, *got.columns) == sorted(want, key=str)
    ids = {r["text"]: r["ids"] for r in bpe.encode(df.select("text", F.col("text").alias("doc_text")), PATH, "doc_text", "text").collect()}
    assert all(ids[t] == library.encode(t or "", add_special_tokens=False).ids for t in texts)


def test_bpe_on_real_texts(library, vocabulary):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall()]
    assert [x.tolist() for x in vocabulary.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_forgotten_and_met_again(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN", 5)
    vocabulary = bpe.Vocabulary(PATH)
    texts = [" ".join(random.Random(k).choice(["alpha", "beta", "<|endoftext|>", "gamma!", f"d{k}"]) for _ in range(9)) for k in range(30)]
    for part in (texts[:7], texts[7:8], texts[8:], texts):
        assert [x.tolist() for x in vocabulary.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_scan_and_heap_agree(vocabulary):
    rng = random.Random(8)
    for _ in range(300):
        word = bytes(rng.choice(b" abethinsor\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        (_, scanned), = vocabulary.merges.scanned([word], len(word))
        assert vocabulary.merges.heaped(word) == scanned


def test_decoding_of_odd_ids(spark, library, vocabulary):
    ids = [[262, 50256, 31], [127, 200, 99999, -1], [], None, [163, 222, 162]]
    got = [r["decoded"] for r in bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k long, ids array<int>").coalesce(1), PATH).orderBy("k").collect()]
    assert got == [library.decode([i for i in x or [] if 0 <= i < 50257], skip_special_tokens=False) for x in ids]
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


# --- conversations --------------------------------------------------------------------------------------------------


def cheapest(rows):
    """Cost, audit and repaired rows by a search over (rows used, state of the pattern), in the order of (cost, edits)."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for initial, name in names.items():
            if (state, initial) in moves:
                heapq.heappush(queue, (cost + 2, edits + "I", i, moves[state, initial], (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in moves and role:
                    heapq.heappush(queue, (cost + more, edits + "K", i + 1, moves[state, role[:1]], (*out, (role, text))))
                for initial, name in names.items():
                    if (state, initial) in moves:
                        heapq.heappush(queue, (cost + 2 + more, edits + "R", i + 1, moves[state, initial], (*out, (name, text))))
    raise AssertionError


def repaired_by_search(conversations):
    groups = defaultdict(list)
    for conv_id, turn, role, text, gone in conversations:
        groups[conv_id].append((turn, " " if role is None else role, " " if text is None else text, gone))
    out, whole = [], {}
    for conv_id, rows in groups.items():
        rows = sorted((r[:3] for r in rows if not r[3]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = re.sub("[ \t-\r]+$", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        whole[conv_id] = lines
        n = Counter(m[2] for m in marked)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=str), whole


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd_conversations():
    rng = random.Random(12)
    rows = []
    for conv_id in [*range(40), None]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv_id, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "Ä"]), rng.choice(["a.", "b!", "cut", " \x0b", "", None, "end? ", "a.\xa0", "x" * 50 + "."]), rng.random() < 0.15))
    rows += [(99, k % 7, ["user", "assistant"][k % 2], f"{k % 90}{'.' if k % 5 else ''}", False) for k in range(400)]  # one with a third of the rows
    rows += [(98, None, "user", None, True), (97, 5, "user", "gone.", True)]
    return rows + rows[5:9]


@pytest.mark.parametrize(("partitions", "long"), [(1, 8 << 20), (7, 8 << 20), (40, 30), (3, 0)])
def test_repair(spark, partitions, long):
    """Conversations within a range, across ranges, in one range alone, and all deferred."""
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"conv_id long, turn long, role string, text string, gone boolean, {EXTRA}")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        want, whole = repaired_by_search(rows)
        assert rows_of(repair(df, long), *RESULT) == want
        found = defaultdict(list)
        for r in sorted(repaired_rows(df, long).collect(), key=lambda r: tuple(r["place"])):
            found[r["conv_id"]].append((r["role"], r["text"]))
        assert dict(found) == {c: lines for c, lines in whole.items() if lines}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repair_against_sql(spark):
    """Damage and repair of odd rows, as the SQL has it."""
    rows = [r[:4] for r in odd_conversations()]
    con = duckdb.connect()
    con.register("conversations", pa.table({c: [r[k] for r in rows] for k, c in enumerate(("conv_id", "turn", "role", "text"))}, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    want = sorted(con.execute(f"SELECT {', '.join(RESULT)} FROM ({REPAIR_SQL})").fetchall(), key=str)
    assert rows_of(repair(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), *RESULT) == want
    assert sum(r[-2] == "" for r in want) >= 0 and ORACLE_SQL["op13_repair"] is REPAIR_SQL


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, None) for t, r, x in ((0, "user", "a. b!"), (1, None, None), (None, "assistant", "c?")) for _ in range(2)]
    rows += [(7, t, "assistant", "Yes. No?") for t in range(60)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        x = ["", "", x.translate(str.maketrans("", "", ".!?"))][kind] if kind < 3 else x
        want += [(c, t, "user" if kind == 4 else r, x, kind == 0)] * (2 if kind == 3 else 1)
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(got, "conv_id", "turn", "role", "text", "gone") == sorted(want, key=str)
    assert {zlib.crc32(f"7:{t}".encode()) % 20 for t in range(60)} >= set(range(5))


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(none)).count() == 0 and repaired_rows(none).count() == 0


def test_the_automaton_stays_small():
    machine, rng = Automaton(), random.Random(2)
    for _ in range(300):
        machine.repair(bytes(rng.randrange(16) for _ in range(60)))
    assert len(machine.vectors) < 60
    assert repair_module.counts(b"")["illegal"] == 0
