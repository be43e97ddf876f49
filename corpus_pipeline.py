"""A training corpus in five stages, each an operator of ``playlake.llm`` over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playlake.llm import huffman
from playlake.llm.decontaminate import without_benchmark
from playlake.llm.minhash import keep_one_of_each
from playlake.llm.mixing import take
from playlake.llm.queries import END_ID, tokenizer_path
from playlake.llm.scratch import materialize
from playlake.llm.toxicity import without_toxic
from playlake.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over their language's threshold go; the classifier learns from the labelled rows of ``documents``."""
    return without_toxic(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the smallest id."""
    ship(spark)
    return keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go."""
    return without_benchmark(docs, _table(spark, sf_dir, "benchmark"), null_items=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once, or twice."""
    return take(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files of token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return huffman.round_trip(docs, tokenizer_path(), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]

#: Stages 1 and 5 aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
