"""The contract queries of the operators in this package, and the SQL that must give the same rows."""

from __future__ import annotations

from playlake.llm.bpe import round_trip_digest
from playlake.llm.decontaminate import benchmark_hits, hits_digest
from playlake.llm.dedup_exact import exact_duplicates
from playlake.llm import huffman
from playlake.llm.minhash import near_duplicates
from playlake.llm.mixing import mix
from playlake.llm.pii import find_pii, pii_digest
from playlake.llm.quality import quality
from playlake.llm.repair import damaged, repair
from playlake.llm.repair_sql import REPAIR_SQL, crc32_sql
from playlake.llm.resample import resample
from playlake.llm.scratch import new_path
from playlake.llm.shards import Store
from playlake.llm.toxicity import toxicity
from playlake.llm.warc import capture_digest, round_trip
from playlake.llm.worker import release
from playlake.shipping import ship


def _table(spark, sf_dir, name):
    ship(spark)
    release(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    """Toxicity of all ``documents``."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark, sf_dir):
    """Archives of all ``pages``, written and read back."""
    return capture_digest(round_trip(_table(spark, sf_dir, "pages")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_ID = 2


def op3_huffman(spark, sf_dir):
    """The token ids of all ``documents``, written and read back."""
    return huffman.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op4_quality(spark, sf_dir):
    """Quality of all ``documents``."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii(spark, sf_dir):
    """Personal data in all of ``documents``."""
    return pii_digest(find_pii(_table(spark, sf_dir, "documents")))


def op6_compaction(spark, sf_dir):
    """All ``documents``, each source an arrival, appended, compacted, and read back through the manifest."""
    from pyspark.sql import functions as F

    store = Store(spark, new_path(spark, "shards"), target_bytes=32 << 20)
    store.append(_table(spark, sf_dir, "documents"), "source")
    store.compact(finish=True)
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_suffix_arrays(spark, sf_dir):
    """Benchmark passages in all ``documents``."""
    return hits_digest(benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), null_items=True))


def op8_minhash(spark, sf_dir):
    """Near duplicates over all of ``documents``."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_hash_mixing(spark, sf_dir):
    """The mix of all ``documents``."""
    return mix(_table(spark, sf_dir, "documents")).drop("copies")


def op10_block_naming(spark, sf_dir):
    """Exact duplicates over all of ``documents``."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_resampling(spark, sf_dir):
    """A tenth of ``documents`` drawn towards the distribution of ``benchmark``; all documents' weights, scores and ranks."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_bpe(spark, sf_dir):
    """All ``documents`` encoded and decoded."""
    import public_tokenizers

    return round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_repair(spark, sf_dir):
    """All ``conversations``, damaged by checksum and repaired."""
    return repair(damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op13_repair": op13_repair,
    "op12_bpe": op12_bpe,
    "op11_resampling": op11_resampling,
    "op6_compaction": op6_compaction,
    "op1_toxicity": op1_toxicity,
    "op4_quality": op4_quality,
    "op7_suffix_arrays": op7_suffix_arrays,
    "op3_huffman": op3_huffman,
    "op8_minhash": op8_minhash,
    "op2_warc": op2_warc,
    "op5_pii": op5_pii,
    "op9_hash_mixing": op9_hash_mixing,
    "op10_block_naming": op10_block_naming,
}

ORACLE_SQL = {
    "op13_repair": REPAIR_SQL,
    "op11_resampling": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
        df AS (SELECT row, f, count(*)::BIGINT AS n FROM (SELECT row, unnest(w) AS f FROM d) GROUP BY row, f),
        bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM b)),
        bucket AS (SELECT f, {crc32_sql("list_transform(range(0, (len(x) // 2)::BIGINT), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)")} % 10000 AS k FROM bytes),
        s AS (SELECT k, sum(n)::BIGINT AS s FROM df JOIN bucket USING (f) GROUP BY k),
        t AS (SELECT k, count(*)::BIGINT AS t FROM b JOIN bucket USING (f) GROUP BY k),
        sizes AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
        g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), sizes),
        w AS (SELECT row, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM df JOIN bucket USING (f) JOIN g USING (k) GROUP BY row),
        v AS (SELECT d.row, doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
                     ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
        c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
        r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM c LEFT JOIN r USING (row)""",
    "op6_compaction": "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "op7_suffix_arrays": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13)::BIGINT AS n, array_to_string(w[i:i + 12], ' ') AS t
               FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
               FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        o AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
        hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM o) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(x, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM d""",
    "op9_hash_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
        w AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM r),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, arg_min(CASE WHEN cap / weight > level THEN level END, CASE WHEN cap / weight > level THEN place_by END) OVER (ORDER BY place_by ROWS UNBOUNDED PRECEDING) AS common
              FROM (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS place_by FROM l)),
        t AS (SELECT source, source_size, coalesce(common * weight, cap) AS target FROM f),
        g AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
        c AS (SELECT g.source, h, words, target - floor(target / source_size) * source_size AS budget,
                     sum(words) OVER (PARTITION BY g.source ORDER BY h) - words AS earlier
              FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WHERE source_size > 0),
        m AS (SELECT source, min(h) + CASE WHEN arg_min(earlier + words - budget < budget - earlier, h) THEN 1 ELSE 0 END AS threshold
              FROM c WHERE earlier + words > budget GROUP BY source)
        SELECT d.doc_id, size, source_size, target,
               size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END + CASE WHEN h < threshold THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source""",
    "op10_block_naming": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
}
