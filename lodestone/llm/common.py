"""Shared helpers: the word rule, native word counts, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices, small_batches
from ..functions.ship import ship

__all__ = ["SPACES", "WORD", "broadcast_if_small", "drop", "drop_written", "private", "read_table", "shared_dir", "ship", "slices", "small_batches", "word_count", "written"]

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as bytes, for ``bytes.translate``; ``bytes.split()`` cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

_written: dict[str, SparkSession] = {}


def private(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that none of ``columns`` has; Spark takes names of another case for the same."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) gets a folder of its own; on a cluster it is an error, for executors would
    write to folders that no other machine sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            folder = shared_dir.own = tempfile.mkdtemp(prefix="lodestone-")
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor then costs a re-read instead of a recomputation. The table goes with ``drop``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` after their last reader has run; frames that still read them end with them."""
    for table in tables:
        _delete(table._written_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone already
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written() -> None:
    """Delete every table that ``written`` has made and nobody has dropped."""
    for path in list(_written):
        _delete(path)


atexit.register(drop_written)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; otherwise as it is, for a shuffled join that AQE splits."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
