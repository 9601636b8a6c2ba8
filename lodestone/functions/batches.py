"""Arrow batches that stay small in an executor's memory, whatever the size of the table."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "4m"
_DEFAULT_BATCH = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Keep this session's Arrow batches to ``BATCH_BYTES`` where nobody has set a size.

    A batch stands in an executor's memory outside of the heap, several times over while it grows. The registered queries and
    the pipeline's stages ask for this; the operators leave the session as it is.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == _DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that a worker holds the Python objects of one slice at a time.

    After the last one the memory that this task has used goes back to the system; workers are kept for later tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
