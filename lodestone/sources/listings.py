"""Stored HTML pages of a gazette archive: links, dates and file names. Fetching pages is left to the caller.

HTML has no native parser in Spark, so a page is read once, over Arrow batches, for all that is asked of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import dates, text
from lodestone.functions.batches import slices
from lodestone.functions.ship import ship

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Links(HTMLParser):
    """Links with their text, whether they stand in a title cell, and the text of the last cell of their row."""

    def __init__(self, title_class: str):
        super().__init__(convert_charrefs=True)
        self.title_class = title_class
        self.links: list[dict] = []
        self.stack: list[str] = []
        self.rows: list[dict] = []
        self.cells: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        named = {k: v or "" for k, v in attrs}
        if tag == "tr":
            self.rows.append({"last": None})
        elif tag == "td":
            cell = {"title": self.title_class in named.get("class", "").split(), "text": []}
            self.cells.append(cell)
            if self.rows:
                self.rows[-1]["last"] = cell
        elif tag == "a":
            self.open = {"href": named.get("href", ""), "text": [], "title": any(c["title"] for c in self.cells), "row": self.rows[-1] if self.rows else None}
            self.links.append(self.open)
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            closed = self.stack.pop()
            if closed == "tr" and self.rows:
                self.rows.pop()
            elif closed == "td" and self.cells:
                self.cells.pop()
            elif closed == "a":
                self.open = None
            if closed == tag:
                return

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"].append(data)
        for c in self.cells:
            c["text"].append(data)


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _row_text(row: dict | None) -> str | None:
    """The text of a row's last cell; the row's links share it."""
    last = row and row["last"]
    if last and "whole" not in last:
        last["whole"] = _joined(last["text"])
    return last["whole"] if last else None


def links_of(html: str | None, base: str | None = "", title_class: str = "cell-title") -> Iterator[dict]:
    parser = _Links(title_class)
    parser.feed(html or "")
    parser.close()
    for pos, x in enumerate(parser.links):
        try:
            url = urljoin(base or "", x["href"])
        except ValueError:
            url = ""
        yield {"pos": pos, "href": x["href"], "url": url, "text": _joined(x["text"]), "in_title": x["title"], "row_text": _row_text(x["row"])}


_LINK = pa.schema([("pos", pa.int32()), ("href", pa.string()), ("url", pa.string()), ("text", pa.string()), ("in_title", pa.bool_()), ("row_text", pa.string())])
#: A task hands links on when it holds this many, or this many characters of them.
_PART_LINKS, _PART_CHARS = 4096, 1 << 20


def _part(ids: pa.Array, rows: list[int], links: list[dict]) -> pa.RecordBatch:
    found = pa.RecordBatch.from_pylist(links, schema=_LINK)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *found.columns], names=["id", *_LINK.names])


def _page_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages are taken out of a batch one at a time, and links go on in parts: Python objects don't grow with the batch."""
    for batch in slices(batches):
        ids, html, base = batch.columns
        rows, links, chars = [], [], 0
        for k in range(batch.num_rows):
            for x in links_of(html[k].as_py(), base[k].as_py()):
                rows.append(k)
                links.append(x)
                chars += len(x["href"]) + len(x["url"]) + len(x["text"]) + len(x["row_text"] or "")
                if len(links) >= _PART_LINKS or chars >= _PART_CHARS:
                    yield _part(ids, rows, links)
                    rows, links, chars = [], [], 0
        if links:
            yield _part(ids, rows, links)


def all_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per link of a page: id, pos, href, absolute url, text, in_title, row_text."""
    ship(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(url_col).alias("base"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(_page_links, f"id {kind}, pos int, href string, url string, text string, in_title boolean, row_text string")
    return out.select(F.col("id").alias(id_col), *_LINK.names)


def latest_listing(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", prefix: str = S.LISTING_LINK_PREFIX) -> DataFrame:
    """Per page the first link of a title cell with the archive's prefix: url, number and date (null if it can't be read)."""
    fit = all_links(pages, id_col, html_col, url_col).where(F.col("in_title") & F.col("href").startswith(prefix))
    first = fit.groupBy(id_col).agg(F.min_by(F.struct("url", "text", "row_text"), "pos").alias("x"))
    return first.select(id_col, F.col("x.url").alias("url"), text.listing_number(F.col("x.text")).alias("gazette_number"), dates.long_date(F.col("x.row_text")).alias("gazette_date"))


def download_link(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", wanted: str = S.DOWNLOAD_TEXT) -> DataFrame:
    """Per page the first link whose text holds the wanted words, in any case, as an absolute url."""
    fit = all_links(pages, id_col, html_col, url_col).where(F.contains(F.lower("text"), F.lit(wanted.lower())))
    return fit.groupBy(id_col).agg(F.min_by("url", "pos").alias("url"))


def is_pdf(content_type):
    """Whether a response's content type is that of a PDF; null is not."""
    return F.coalesce(F.contains(content_type, F.lit("application/pdf")), F.lit(False))


def unseen(found: DataFrame, notices: DataFrame) -> DataFrame:
    """Listings whose number and date no stored notice has; those without a date are always taken. Numbers compare by digits."""
    once = found.dropDuplicates(["gazette_number", "gazette_date"]).withColumn("__n", text.digits(F.col("gazette_number")))
    have = notices.where("gazette_date is not null").select(text.digits(F.col("gazette_number")).alias("__n"), "gazette_date").distinct()
    return once.join(have, ["__n", "gazette_date"], "left_anti").select(*found.columns)
