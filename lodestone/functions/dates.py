"""Date and number functions on columns. The run's date and time are arguments, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank


def iso_date(c: Column) -> Column:
    """Strict ``yyyy-MM-dd``; null otherwise."""
    return F.try_to_date(c, "yyyy-MM-dd")


def long_date(c: Column) -> Column:
    """``7 November 2025``; null otherwise."""
    return F.try_to_date(c, "d MMMM yyyy")


def published_date(text: Column, gazette_date: Column, run_date: Column) -> Column:
    """A stated date if it can be read, else the run's date; without a statement the gazette's date, else the run's."""
    return F.when(~is_blank(text), F.coalesce(iso_date(text), run_date)).otherwise(F.coalesce(gazette_date, run_date))


def year_of(c: Column) -> Column:
    """The year of a date, as of the run's, under which listings are kept."""
    return F.year(c)


def short_stamp(c: Column) -> Column:
    return F.date_format(c, "MMM d, h:mm a")


def full_date(c: Column) -> Column:
    return F.date_format(c, "MMMM d, yyyy")


def full_stamp(c: Column) -> Column:
    return F.date_format(c, "MMMM d, yyyy h:mm a")


def iso_date_text(c: Column) -> Column:
    return c.cast("string")


def iso_stamp_text(c: Column) -> Column:
    """ISO text of a date and time: ``T`` between them, zero seconds left out, fractions in groups of three digits."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"000$", ""), r"\.000$", ""), r"^(.{16}):00$", "$1")


def percentage(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0.0 where whole is 0."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def rate_text(c: Column) -> Column:
    return F.concat(F.format_number(c, 1), F.lit("%"))


def int_or(c: Column, default: int) -> Column:
    """A whole number from text, cut towards zero; the default where there is none."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))
