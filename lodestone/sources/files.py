"""PDF files as a source: bytes by ``binaryFile``, text by a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hadoop import new_file
from lodestone.functions.ship import ship
from lodestone.functions.text import is_blank
from lodestone.sources import pdf

#: (bytes of a file) -> (text of page 1 as a vision model reads it, text of the other pages, text of all pages); None where there is none
Extractor = Callable[[bytes], tuple[str | None, str | None, str | None]]


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder; only the columns that are used are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def plain_text(data: bytes) -> tuple[str | None, str | None, str | None]:
    """The extractor for files that are text already."""
    return None, None, data.decode("utf-8", "replace")


def pdf_text(data: bytes) -> tuple[str | None, str | None, str | None]:
    """Text of a PDF by this package's own reader (``sources/pdf.py`` says what it reads)."""
    pages = pdf.pages_text(data)
    return None, "\n".join(pages[1:]), "\n".join(pages) or None


def file_text(data: bytes) -> tuple[str | None, str | None, str | None]:
    """Text of a file of either kind, told apart by its first bytes."""
    return pdf_text(data) if b"%PDF-" in data[:1024] else plain_text(data)


def pypdf_text(data: bytes) -> tuple[str | None, str | None, str | None]:
    """Text of a PDF where the optional library is installed."""
    import io

    from pypdf import PdfReader

    pages = [p.extract_text() for p in PdfReader(io.BytesIO(data)).pages]
    return None, "\n".join(pages[1:]), "\n".join(pages) or None


def high_fidelity(first: Column, rest: Column) -> Column:
    """Page 1 from the vision model, a blank line, then the text of the other pages; null where the model gave nothing."""
    return F.when(~is_blank(first), F.concat(first, F.lit("\n\n"), F.coalesce(rest, F.lit(""))))


def extract_text(files: DataFrame, extractor: Extractor = file_text) -> DataFrame:
    """(original_pdf_path, text): the vision text, or the plain text of all pages where that is blank. A file that can't be read has null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p["path"], p["content"], strict=True):
                try:
                    rows.append((path, *extractor(bytes(data))))
                except Exception:  # noqa: BLE001 - one bad file must not end the batch; it shows as a null text
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "first", "rest", "plain"])

    ship(files.sparkSession)
    read = files.select("path", "content").mapInPandas(run, "path string, first string, rest string, plain string")
    best = high_fidelity(F.col("first"), F.col("rest"))
    return read.select(F.col("path").alias("original_pdf_path"), F.when(is_blank(best), F.col("plain")).otherwise(best).alias("text"))


def upload(landing: str, name: str, data: bytes, spark: SparkSession | None = None) -> str:
    """Where an uploaded file goes in a landing folder that the stream watches; an empty one is refused.

    With a session it is put there: written under a hidden name and renamed, so that a stream never sees half of it.
    """
    if not data:
        raise ValueError("the file is empty")
    at = str(PurePosixPath(landing) / PurePosixPath(name).name)
    if spark is not None:
        with new_file(spark, at) as out:
            out.write(data)
    return at
