"""String functions on columns. All are built from native expressions and keep null as null unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schema as S


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BLANKS = "".join(map(chr, range(0x21)))


def trim_ws(c: Column) -> Column:
    """Cut all characters up to U+0020 from both ends; ``trim`` cuts spaces only."""
    return F.trim(c, F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    """True for null, empty and white space, including that beyond ASCII."""
    return F.coalesce(~F.regexp_like(c, F.lit(r"[^\s\p{Z}]")), F.lit(True))


def strip_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


def strip_fence(c: Column) -> Column:
    """Take the content out of a fenced JSON block."""
    return trim_ws(F.when(F.contains(c, F.lit("```json")), F.regexp_replace(c, r"(?s)```json\s*(.*?)\s*```", "$1")).otherwise(c))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order; null for null."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def has_prefix(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def has_part(c: Column, part: str) -> Column:
    """Whether a text holds another, by code point."""
    return F.contains(c, F.lit(part))


def lowered(c: Column) -> Column:
    return F.lower(c)


def without(c: Column, part: str) -> Column:
    """Less every occurrence of a literal text."""
    return F.replace(c, F.lit(part), F.lit(""))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z_]", "")


def head(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def truncate(c: Column, n: int = S.CELL_CHARS, suffix: str = "...[TRUNCATED]") -> Column:
    """At most n code points, with a suffix where something was cut; null gives the empty text."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(or_empty(c))


def label(c: Column) -> Column:
    """A category name for display."""
    return F.translate(c, "_", " ")


def or_label(c: Column, text: str = "N/A") -> Column:
    return F.coalesce(c, F.lit(text))


def file_identifier(url: Column) -> Column:
    """Last path segment without ``.pdf``."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".pdf"), F.lit(""))


def archive_name(number: Column, date: Column) -> Column:
    before, between, after = S.ARCHIVE_NAME
    return F.concat(F.lit(before), F.regexp_replace(number, "[^a-zA-Z0-9]", "_"), F.lit(between), F.coalesce(date.cast("string"), F.lit("Unknown_Date")), F.lit(after))


def export_name(path: Column, extension: str = ".csv") -> Column:
    return F.concat(F.lit("Export_"), F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".pdf"), F.lit("")), F.lit(extension))


def listing_number(text: Column) -> Column:
    return trim_ws(F.replace(text, F.lit(S.LISTING_PREFIX), F.lit("")))


def digits(c: Column) -> Column:
    """Runs of digits, one space between them, for comparing issue numbers that are written in different ways."""
    return F.trim(F.regexp_replace(c, "[^0-9]+", " "))


def find_number(raw: Column, pattern: str = S.NOTICE_NUMBER) -> Column:
    """The first notice number in a text, or the empty text."""
    return F.coalesce(F.regexp_extract(raw, pattern, 1), F.lit(""))


def segments(text: Column, marker: str = S.NOTICE_MARKER) -> Column:
    """A document's notices, in order.

    The text is cut before every marker and the pieces are trimmed; empty ones go. If the first piece that is left holds no
    marker at its start it is a preamble and goes. A text that has words but no piece left is one notice, untrimmed. A null
    text gives null.
    """
    flags, _, body = marker.partition(")") if marker.startswith("(?") else ("", "", marker)
    flags = flags + ")" if flags else ""
    cut = F.split(text, f"{flags}(?={body})", -1)
    pieces = F.filter(F.transform(cut, trim_ws), lambda x: x != "")

    def less_preamble(pieces: Column) -> Column:
        preamble = F.coalesce(~F.regexp_like(F.get(pieces, 0), F.lit(f"{flags}\\A(?:{body})")), F.lit(False))
        return F.when(preamble, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)

    return let(let(pieces, less_preamble), lambda kept: F.when((F.size(kept) == 0) & ~is_blank(text), F.array(text)).otherwise(kept))
