"""Filters, orders and pages over notices.

Null dates come first in descending and last in ascending order, as stored lists have them. Orders that were not total end
in the id. The category queries do filter by category, as they are declared to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.text import is_blank

Order = list[Column]

LIST_COLUMNS = ["id", "title", "category", "status", "gazette_number", "gazette_date", "source_order", "view_count", "thumbs_up", "significance_rating"]


def official_order() -> Order:
    return [F.col("gazette_date").desc_nulls_first(), F.col("source_order").asc_nulls_last(), F.col("id").asc()]


def popular_order() -> Order:
    return [F.col("view_count").desc_nulls_first(), F.col("gazette_date").desc_nulls_first(), F.col("id").desc()]


def most_viewed_order() -> Order:
    return [F.col("view_count").desc_nulls_first(), F.col("id").desc()]


def significant_order() -> Order:
    return [F.col("significance_rating").desc_nulls_first(), F.col("id").desc()]


def recent_order() -> Order:
    return [F.col("id").desc()]


def succeeded(n: DataFrame) -> DataFrame:
    return n.where(F.col("status") == S.SUCCESS)


def failed(n: DataFrame) -> DataFrame:
    return n.where(F.col("status") == S.FAILED)


def in_category(n: DataFrame, category: str) -> DataFrame:
    return n.where((F.col("category") == category) & (F.col("status") == S.SUCCESS))


def by_number(n: DataFrame, number: str, date: str | None = None) -> DataFrame:
    """Notices of an issue number, of one date if it is given."""
    out = n.where(F.col("gazette_number") == number)
    return out if date is None else out.where(F.col("gazette_date") == F.lit(date).cast("date"))


def first_of_issue(n: DataFrame, number: str, date: str) -> DataFrame:
    """At most one row: whether an issue is stored already."""
    return by_number(n, number, date).limit(1)


def by_path(n: DataFrame, path: str) -> DataFrame:
    return n.where(F.col("original_pdf_path") == path)


def with_path(n: DataFrame) -> DataFrame:
    return n.where(F.col("original_pdf_path").isNotNull())


def by_id(n: DataFrame, notice_id: int) -> DataFrame:
    return n.where(F.col("id") == notice_id)


def liked(n: DataFrame) -> DataFrame:
    return n.where(F.col("thumbs_up") > 0)


def with_category(n: DataFrame) -> DataFrame:
    return n.where(F.col("category").isNotNull())


def is_significant() -> Column:
    return F.col("significance_rating") >= S.POST_SIGNIFICANCE


def posts(n: DataFrame) -> DataFrame:
    """What is to be posted: short summaries of published notices of high significance."""
    return succeeded(n).where(is_significant()).select("id", "x_summary")


def to_retry(n: DataFrame) -> DataFrame:
    """Failed notices of either kind, in no order."""
    return failed(n).where(F.col("title").startswith(S.GENERATION_FAILED) | F.col("title").startswith(S.PROCESSING_FAILED))


def retryable(n: DataFrame) -> DataFrame:
    """Failed notices of either kind, in official order."""
    return to_retry(n).orderBy(*official_order())


def generation_failures(n: DataFrame) -> DataFrame:
    return failed(n).where(F.col("title").startswith(S.GENERATION_FAILED))


def batch_has_failures(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("has_failures", F.col("failed_count") > 0)


def blank_content(n: DataFrame) -> DataFrame:
    return n.where(is_blank(F.col("content")))


def page(n: DataFrame, order: Order, number: int = 1, size: int = S.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of an order. Sort, offset and limit become one top-k per task and one merge."""
    if number < 1:
        raise ValueError("pages are numbered from 1")
    return n.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(n: DataFrame, size: int = S.PAGE_SIZE) -> DataFrame:
    """One row: total_elements and total_pages."""
    total = F.count("*")
    return n.agg(total.alias("total_elements"), F.ceil(total / size).cast("long").alias("total_pages"))


def public_list(n: DataFrame, sort: str | None = None, number: int = 1, size: int = S.PAGE_SIZE) -> DataFrame:
    orders = {"popular": popular_order, "significant": significant_order}
    return page(succeeded(n), orders.get(sort or "", recent_order)(), number, size)


def category_list(n: DataFrame, category: str, sort: str | None = None, number: int = 1, size: int = S.PAGE_SIZE) -> DataFrame:
    orders = {"popular": most_viewed_order, "significant": significant_order, "official": official_order}
    return page(in_category(n, category), orders.get(sort or "", recent_order)(), number, size)


def admin_list(n: DataFrame, sort: str | None = None) -> DataFrame:
    """``official`` (also under its older name ``oldest``) is the newest issue first."""
    orders = {"official": official_order, "oldest": official_order, "popular": most_viewed_order, "significant": significant_order}
    return n.orderBy(*orders.get(sort or "", recent_order)())


def top_liked(n: DataFrame, k: int = 3) -> DataFrame:
    """The k most liked published notices; ties stand in official order."""
    return liked(succeeded(n)).orderBy(F.col("thumbs_up").desc(), *official_order()).limit(k)
