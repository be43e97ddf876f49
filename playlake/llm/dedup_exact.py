"""Exact deduplication by deterministic block naming, with DataFrame functions only.

The normalised text is cut into blocks of a fixed number of characters.  Distinct blocks are put in order and numbered: equal
blocks have equal names, different blocks different names, by comparison of their content and not by trust in a hash.
Adjacent names are then paired, distinct pairs sorted and numbered, and so on until each document has one name.  Two
documents are equal if and only if their numbers of blocks and their last names agree.

The order of blocks is that of their addresses, 64-bit hashes, so that content crosses the network once, map-side combined to its
distinct blocks.  If different blocks share an address anywhere, those are put in the order of their content: each gets a place at its
address, in a join of its own, and is named by both.  So names are those of contents, whatever the hash.

Defined results: a null text is the empty text; empty texts are equal to each other; rows that repeat a doc_id with the
same text stay together (``kept`` compares doc_id with keep_id, null-safe); null doc_ids come last in the order of the
smallest, so they are kept only in groups that have no other; columns beside the id and the text aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playlake.llm.scratch import Scope, materialize

BLOCK_CHARS = 2048


def normalised(text):
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def _blocks(text, block_chars: int):
    """A text's blocks in order; the empty text has one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct keys over the whole table and number them in that order."""
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def block_names(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS, address=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_blocks, name; (n_blocks, name) identifies the normalised text.  ``address``: block → long."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    cut = texts.select("doc_id", "text", _blocks(F.col("text"), block_chars).alias("blocks"))
    slim = cut.select(
        "doc_id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.size("blocks").alias("n_blocks"),
        F.transform("blocks", lambda b: address(b)).alias("addresses"),
    )
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "rows")

    found = cut.select(F.explode("blocks").alias("block")).select(address(F.col("block")).alias("address"), "block")
    different = materialize(found.dropDuplicates().select("address"), "different")
    contents = materialize(different.groupBy("address").agg(F.count(F.lit(1)).cast("int").alias("n")), "contents")
    # The place of a block among those at its address: 0 unless two different blocks share a 64-bit hash.
    places = contents.select("address", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    names = _numbered(places, ["address", "place"])
    at = slim.select("row", F.posexplode("addresses").alias("pos", "address"))
    shared = contents.filter("n > 1").select("address")
    if shared.isEmpty():
        at = at.withColumn("place", F.lit(0))
    else:
        at = _with_places(at, slim, texts, found.join(shared, "address", "left_semi").dropDuplicates(), block_chars)
    level = materialize(at.join(names, ["address", "place"]).select("row", "pos", "name"), "level")

    done = level.join(slim.filter("n_blocks = 1"), "row", "left_semi").select("row", "name")
    rest, longest = slim.filter("n_blocks > 1"), slim.agg(F.max("n_blocks")).first()[0] or 1
    parts, level = [done], level.join(rest, "row", "left_semi")
    width = 1
    while width < longest:
        width *= 2
        pairs = materialize(
            level.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        level = materialize(pairs.join(names, ["left", "right"]).select("row", "pos", "name"), "level")
        ended = slim.filter((F.col("n_blocks") > width // 2) & (F.col("n_blocks") <= width))
        parts.append(level.join(ended, "row", "left_semi").select("row", "name"))
        level = level.join(slim.filter(F.col("n_blocks") > width), "row", "left_semi")
    last = parts[0]
    for part in parts[1:]:
        last = last.unionByName(part)
    return slim.join(last, "row").select("row", "doc_id", "text_sha256", "n_blocks", "name")


def _with_places(at: DataFrame, slim: DataFrame, texts: DataFrame, shared: DataFrame, block_chars: int) -> DataFrame:
    """Addresses that several contents share: documents that use one are read again, matched by their text's SHA-256."""
    shared = materialize(shared.withColumn("place", F.row_number().over(Window.partitionBy("address").orderBy("block")) - 1), "shared")
    users = at.join(shared.select("address").distinct(), "address", "left_semi").select("row").distinct()
    users = slim.join(users, "row", "left_semi").select("row", "text_sha256")
    full = texts.select("text", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")).join(users.select("text_sha256").distinct(), "text_sha256", "left_semi").dropDuplicates(["text_sha256"])
    blocks = users.join(full, "text_sha256").select("row", F.posexplode(_blocks(F.col("text"), block_chars)).alias("pos", "block"))
    placed = blocks.join(shared, "block").select("row", "pos", "place")
    return at.join(placed, ["row", "pos"], "left").select("row", "pos", "address", F.coalesce("place", F.lit(0)).alias("place"))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS, address=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    with Scope(docs.sparkSession) as scope:
        named = scope.keep(materialize(block_names(docs, text_col, id_col, block_chars, address), "named"))
        groups = scope.keep(materialize(named.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
