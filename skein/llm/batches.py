"""Size of the Arrow batches in which texts go to Python."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.plans.storage import materialize

ROWS = 1000
BYTES = 16 << 20
_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = ROWS, most_bytes: int = BYTES) -> Iterator[None]:
    """Limits Arrow batches for the plans that run inside, and gives the session its own settings back.

    With the default of 10,000 rows, each task would hold some 100 MB of texts several times over.
    """
    before = [spark.conf.get(s, None) for s in _SETTINGS]
    for s, value in zip(_SETTINGS, (rows, most_bytes), strict=True):
        spark.conf.set(s, str(value))
    try:
        yield
    finally:
        for s, value in zip(_SETTINGS, before, strict=True):
            spark.conf.unset(s) if value is None else spark.conf.set(s, value)


def give_back() -> None:
    """Return memory that a task has freed to the machine: workers live on, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialize` with bounded batches: for plans that hand texts or sets to Python."""
    with bounded_batches(df.sparkSession):
        return materialize(df, label)
