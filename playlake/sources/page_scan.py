"""Stored pages of the service as a table that is scanned page by page, and only as far as a range of seconds needs.

Pages are written as files of one page each, whose names tell the page's number and its oldest and newest second.  A scan lists the names, drops the pages
that a pushed filter excludes before anything is opened, and reads each other page in a partition of its own.  What is in the pages is parsed by native functions
(:mod:`playlake.sources.pages`).  Files are reached through Arrow's file systems.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from playlake.shipping import ship
from playlake.sources.pages import api_tracks, api_window, chart_rows, clip_to_pin, until_stop
from playlake.streaming.tail import opened

_NAME = re.compile(r"page-(\d+)-(\d+|none)-(\d+|none)\.(json|html)")
#: The facts of a page that stand in its name.
FACTS = ("page_number", "oldest", "newest")
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class PageFile(InputPartition):
    """One stored page."""

    def __init__(self, path: str, page_number: int, oldest: int | None, newest: int | None):
        self.path, self.page_number, self.oldest, self.newest = path, page_number, oldest, newest


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the facts in names with numbers; a page without plays has no bounds and is excluded by none of them."""
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and f.attribute[0] in FACTS and isinstance(f.value, int):
                self.filters.append((f.attribute[0], _COMPARED[type(f)], f.value))
            yield f  # Spark applies them too: names only say which pages needn't be opened

    def partitions(self) -> list[PageFile]:
        files, root = opened(self.path)
        from pyarrow import fs

        found = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.is_file and (m := _NAME.fullmatch(info.base_name)):
                page = PageFile(info.path, int(m[1]), *(None if x == "none" else int(x) for x in (m[2], m[3])))
                if all(getattr(page, name) is not None and compare(getattr(page, name), value) for name, compare, value in self.filters):
                    found.append(page)
        # Spark needs one partition at least.
        return sorted(found, key=lambda p: (p.page_number, p.path)) or [PageFile("", 0, None, None)]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            files, _ = opened(self.path)
            with files.open_input_stream(partition.path) as file:
                body = file.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict({"page_number": pa.array([partition.page_number], pa.int64()), "oldest": pa.array([partition.oldest], pa.int64()), "newest": pa.array([partition.newest], pa.int64()), "body": [body]})


class StoredPages(DataSource):
    """``spark.read.format("stored_pages").load(folder)``: page_number, oldest, newest, body."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "page_number long, oldest long, newest long, body string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """All stored pages; filters of page_number, oldest and newest reach the list of files."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredPages)
    return spark.read.format("stored_pages").load(path)


def _writing(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for number, oldest, newest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds = "-".join("none" if x is None else str(x) for x in (oldest, newest))
                with files.open_output_stream(f"{root.rstrip('/')}/page-{number:06d}-{bounds}.{kind}") as out:
                    out.write((body or "").encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    return run


def store_pages(pages: DataFrame, path: str, kind: str = "json") -> None:
    """Write pages (page_number, oldest, newest, body) as files; a page that is written again replaces itself."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_number").cast("long"), F.col("oldest").cast("long"), F.col("newest").cast("long"), "body")
    rows.mapInArrow(_writing(path, kind), "n long").write.format("noop").mode("overwrite").save()


def window(spark: SparkSession, path: str, start: int | None, pin: int | None) -> DataFrame:
    """The tracks of the pages that hold seconds from ``start`` (widened by one) up to the pin: page_number, place, name, artist, album, timestamp.

    Rows from the pin on are clipped.  Rows older than the start stay where their page was read, since they show that the window is complete.
    """
    lo, hi = api_window(start, pin)
    pages = stored_pages(spark, path)
    pages = pages if lo is None else pages.filter(F.col("newest") >= lo)
    pages = pages if hi is None else pages.filter(F.col("oldest") < hi)
    return api_tracks(pages.select(F.col("page_number").alias("file_number"), "body"), before=pin)


def scraped_window(spark: SparkSession, path: str, pin: int | None) -> DataFrame:
    """The rows of stored HTML pages up to the pin; such pages can't be asked for from a second on, so all are read."""
    pages = stored_pages(spark, path)
    pages = pages if pin is None else pages.filter(F.col("oldest").isNull() | (F.col("oldest") < pin))
    return clip_to_pin(chart_rows(pages.select(F.col("page_number").alias("page"), F.col("body").alias("html"))), pin)


def newer_than(spark: SparkSession, path: str, stop: int, first_page: int = 1) -> DataFrame:
    """The tracks of a newest-first feed from a page on, before the first that isn't newer than ``stop``."""
    pages = stored_pages(spark, path).filter((F.col("page_number") >= max(1, first_page)) & (F.col("newest") > stop))
    return until_stop(api_tracks(pages.select(F.col("page_number").alias("file_number"), "body")), stop)
