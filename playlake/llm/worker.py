"""Bounds on the memory of Python workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

# Rows and bytes of a batch of texts on its way to a Python worker, and rows that are decoded at once: documents can be long.
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}
_HELD: dict[Any, Any] = {}


def bound_batches(spark: SparkSession) -> None:
    """Let batches of texts be small, unless the session has its own settings.

    Spark reads these when a plan is run, which may be long after the operator has returned; so they stay until :func:`release`.
    """
    for setting, value in _BOUNDS.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, value)


def release(spark: SparkSession) -> None:
    """Take back what :func:`bound_batches` has set in this session, so that later queries don't read in small batches."""
    for setting, value in _BOUNDS.items():
        if spark.conf.get(setting, None) == str(value):
            spark.conf.unset(setting)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The one object that a worker process remembers from task to task: asking for another drops it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
