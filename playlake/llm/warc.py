"""WARC archives: write records, read them back, and assemble request, response and metadata into one row per capture.

Writing: a record's bytes end with two line breaks, so Spark's text writer with that line separator writes WARC
files, compressed and committed by Spark on any file system.  A capture has a request, a response (or, where an equal payload has
a response already, a revisit that refers to it) and a metadata record, tied by WARC-Concurrent-To.

Reading: Spark's text reader cuts a file, compressed or not, where a record may begin, and each task puts the pieces together to
records by their Content-Length, one after another: it holds one record at a time, however long the file is.  Files of
concatenated gzip members work as well.  A file is read by one task, so the writer bounds its records by :data:`FILE_ROWS`; its
bytes are those of a partition, which adaptive execution keeps near its advised size.

Assembly: request and metadata records name their response in WARC-Concurrent-To; one grouping by that id gives one
nested row per capture.  Ids are unique, so no group exceeds the records of its capture.

Defined results: a null html or url is empty; equal payloads of at least ``min_bytes`` are told by length and SHA-1;
the smallest id of each has the response (null ids come last).  Record ids are made of the page ids where no two rows share one;
otherwise of page id and row, so each row is a capture of its own.  The digest calls pages with a null id revisits of nothing, as
the contract's SQL does, also where they have the response; columns beside
id, url and payload aren't read.  A record that is cut off at a file's end raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playlake.llm.scratch import Scope, freed_shuffles, materialize, new_path
from playlake.llm.worker import bound_batches

EOL = "\r\n"
FILE_ROWS = 2000
# The alphabets of base 32, as numerals and as RFC 4648 writes them.
NUMERALS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in upper-case base 32."""
    hex40 = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hex40, i * 10 + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), NUMERALS, BASE32)


def _record(kind: str, record_id: Column, more: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Record-ID: <"), record_id, F.lit(f">{EOL}WARC-Date: 2024-01-01T00:00:00Z{EOL}")]
    for name, value in more:
        head.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(EOL))))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block)


def captures_to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row per record, column ``value``: its text without the two line breaks that end it."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ")
    full = pages.select(F.col(id_col).alias("id"), url.alias("url"), text.alias("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    slim = materialize(full.select("id", "digest", "bytes"), "digests")
    name = F.concat(F.lit("urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    if slim.groupBy("id").count().filter("count > 1").limit(1).count():
        # The row's number is written with the payload, so that all that read it see the same.
        full = materialize(full.withColumn("row", F.monotonically_increasing_id()), "rows")
        name = F.concat(name, F.lit("."), F.col("row").cast("string"))
        slim = full
    full, slim = full.withColumn("rid", name), slim.withColumn("rid", name)
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "rid")).alias("least")
    first = slim.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(least).select("digest", "bytes", F.col("least.id").alias("first"), F.col("least.rid").alias("first_rid"))
    first = materialize(first, "firsts")
    full = full.join(first, ["digest", "bytes"], "left")
    is_first = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    rid = F.col("rid")
    refers = F.concat(F.lit("<"), F.col("first_rid"), F.lit(":response>"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    to = [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.concat(F.lit("<"), rid, F.lit(":response>")))]
    response = _record("response", F.concat(rid, F.lit(":response")), [*common, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")))
    revisit = _record("revisit", F.concat(rid, F.lit(":response")), [*common, ("WARC-Refers-To", refers), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _record("request", F.concat(rid, F.lit(":request")), [*to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{EOL}{EOL}")))
    metadata = _record("metadata", F.concat(rid, F.lit(":metadata")), [*to, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("captureId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{EOL}payloadBytes: "), F.col("bytes").cast("string"), F.lit(EOL)))
    return full.select(F.explode(F.array(request, F.when(is_first, response).otherwise(revisit), metadata)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files."""
    records.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, block binary"
_ARROW = pa.schema([(n, pa.binary() if n == "block" else pa.string()) for n in (f.split()[0] for f in RECORD.split(", "))])
# The header fields that become columns.
_FIELDS = {b"warc-record-id": "record_id", b"warc-type": "record_type", b"warc-target-uri": "target_uri", b"warc-concurrent-to": "concurrent_to", b"warc-refers-to": "refers_to", b"warc-payload-digest": "payload_digest"}


#: Where a record may begin, in any version of the format.
MARK = b"WARC/1."


class _Records:
    """Pieces of a file between marks → its records."""

    def __init__(self) -> None:
        self.open: bytearray | None = None

    def add(self, piece: bytes) -> dict | None:
        """The record that this piece ends, if it does; a mark within a record is part of it."""
        if self.open is None:
            if not piece.strip():  # before the first record
                self.open = bytearray()
                return None
            raise ValueError("this isn't a WARC file")
        self.open += (MARK if self.open else b"") + piece
        return self._ended()

    def _ended(self) -> dict | None:
        end = self.open.find(b"\r\n\r\n")
        if end < 0:
            return None
        row, length = dict.fromkeys(_ARROW.names), 0
        for line in bytes(self.open[:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip()
            if name == b"content-length":
                length = int(value)
            elif name in _FIELDS:
                row[_FIELDS[name]] = value.decode("utf-8", "replace").strip("<>") if name != b"warc-target-uri" else value.decode("utf-8", "replace")
        start = end + 4
        if len(self.open) < start + length:
            return None
        if self.open[start + length :].strip():
            raise ValueError("a WARC record goes on behind its length")
        row["block"] = bytes(self.open[start : start + length])
        self.open = bytearray()
        return row

    def end(self) -> None:
        if self.open:
            raise ValueError("a WARC record is cut off")


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of a whole archive in memory, plain or gzipped."""
    if content[:2] == b"\x1f\x8b":
        import gzip

        content = gzip.decompress(content)
    records = _Records()
    for piece in content.split(MARK) if content else []:
        if (row := records.add(piece)) is not None:
            yield row
    records.end()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, file, rows, size = _Records(), None, [], 0
    for batch in batches:
        for piece, name in zip(batch.column("piece"), batch.column("file").to_pylist(), strict=True):
            if name != file:
                records.end()
                records, file = _Records(), name
            if (row := records.add(piece.as_py())) is not None:
                rows.append(row)
                size += len(row["block"])
                if size > 4 << 20 or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
    records.end()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_warc(spark: SparkSession, path: str, glob: str = "*.gz") -> DataFrame:
    """One row per record of the archives below ``path``, compressed or not; a file is read by one task, record by record.

    The text reader keeps a line's bytes as they are, so payloads in any encoding come through.  It deals large plain files out in
    splits, within which records go on; these files' pieces are put in order again by file and split first, sorted on disk if need be.
    """
    bound_batches(spark)
    lines = spark.read.option("lineSep", MARK.decode()).option("pathGlobFilter", glob).text(path)
    pieces = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    packed = pieces.select("piece", "file") if glob.endswith(".gz") else pieces.filter(F.col("file").endswith(".gz")).select("piece", "file")
    if not glob.endswith(".gz"):
        plain = pieces.filter(~F.col("file").endswith(".gz")).withColumn("place", F.monotonically_increasing_id())
        ordered = plain.repartition("file").sortWithinPartitions("file", "split", "place").select("piece", "file")
        return packed.mapInArrow(_parse, RECORD).unionByName(ordered.mapInArrow(_parse, RECORD))
    return packed.mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (the response's record id) and structs request, response, metadata; ``response.payload`` is the block after its HTTP header."""
    block = F.col("block")
    text = block.cast("string")
    header = F.locate(EOL + EOL, text)
    # The header is ASCII, so its end has the same place in characters and bytes.
    payload = F.when(F.col("record_type") == "response", F.substring(block, header + 4, F.octet_length(block))).otherwise(F.lit(None).cast("binary"))
    main = F.col("record_type").isin("response", "revisit")
    keyed = records.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    keyed = keyed.withColumn("payload", payload).withColumn("block", F.when(~main, text))
    side = {k: F.max(F.when(F.col("record_type") == k, F.struct("record_id", "target_uri", "block"))).alias(k) for k in ("request", "metadata")}
    response = F.max(F.when(main, F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload"))).alias("response")
    return keyed.groupBy("capture").agg(side["request"], response, side["metadata"])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back, and assemble the captures."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    with Scope(spark), freed_shuffles(spark):
        write_warc(captures_to_records(pages, id_col, url_col, payload_col, min_bytes), path)
    return assemble(read_warc(spark, path))


def capture_digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes and payload_digest (of the full payload), record_type as the archive has it, refers_to (null where the response's page has no id)."""
    number = lambda c: F.regexp_extract(c, r"^urn:capture:(-?[0-9]+)[.:]", 1).try_cast("long")
    return captures.select(
        number(F.col("capture")).alias("page_id"),
        F.coalesce(F.octet_length("response.payload"), F.regexp_extract("metadata.block", r"payloadBytes: ([0-9]+)", 1).cast("int")).cast("long").alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("response.payload")), F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", number(F.col("response.refers_to"))).alias("refers_to"),
    )
