"""Arguments and labels: ranges, times, ids."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F


def parse_range(text: str) -> tuple[int, int]:
    """``a-b`` with whole numbers, a not above b."""
    parts = text.split("-")
    if len(parts) != 2 or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"expected start-end, got {text!r}")
    start, end = map(int, parts)
    if start > end:
        raise ValueError(f"{start} is above {end}")
    return start, end


def parse_time(text: str) -> int:
    """Seconds: a number, or a day as yyyy-mm-dd, which is its midnight in UTC."""
    if text.isascii() and text.isdigit():
        return int(text)
    return int(datetime.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=datetime.UTC).timestamp())


def time_of(text: Column) -> Column:
    """:func:`parse_time` for a column; null where it can't be read."""
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-M-d"))))
    return F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long")).otherwise(day)


def time_text(uts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, given a session in UTC."""
    return F.date_format(F.timestamp_seconds(uts), "yyyy-MM-dd HH:mm:ss")


def edit_id(at: Column, operation: Column, seq: Column) -> Column:
    """``e{at}-{first 8 hex digits of the SHA-256 of the operation's text}-{seq}``."""
    return F.concat(F.lit("e"), at.cast("string"), F.lit("-"), F.substring(F.sha2(F.encode(operation, "UTF-8"), 256), 1, 8), F.lit("-"), seq.cast("string"))


def number_of(at: Column, operation: Column) -> Column:
    """An :func:`edit_id` whose last part comes from the operation itself, sixty bits of the same digest, so that those of one pass differ without being counted."""
    return edit_id(at, operation, F.conv(F.substring(F.sha2(F.encode(operation, "UTF-8"), 256), 9, 15), 16, 10))
