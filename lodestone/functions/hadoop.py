"""Bytes to any file system that Spark can write to."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class _Out(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            super().close()
            self.stream.close()


@contextmanager
def new_file(spark: SparkSession, path: str) -> Iterator[io.BufferedWriter]:
    """A binary file to write at ``path``. It is written under a hidden name and renamed when it is whole, so that nobody sees
    half of it; after an error there is none."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = kind(path)
    hidden = kind(target.getParent(), f"_{target.getName()}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = io.BufferedWriter(_Out(fs.create(hidden, True)), 1 << 20)
    try:
        with out:
            yield out
    except BaseException:
        fs.delete(hidden, False)
        raise
    fs.delete(target, False)
    if not fs.rename(hidden, target):
        raise OSError(f"can't put a file at {path}")
