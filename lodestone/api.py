"""The engine's entry points, one function per route of the application that it serves. No web server: frames in, frames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone import schema as S
from lodestone.functions.text import label
from lodestone.operators import export, ingest, metrics, mutations, queries
from lodestone.operators.model import Model
from lodestone.sources import files, listings
from lodestone.streaming.ingest import stop_ingest

__all__ = ["home", "notice", "categories", "dashboard", "admin_content", "edit_form", "add", "update", "delete", "post", "export_all", "retry_failed", "thumbs", "run_scraper", "category", "batches", "delete_batch", "delete_bulk", "export_batch", "pdf_path", "stop_processing"]


def home(n: DataFrame, page: int = 1, sort: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of published notices, and its counts."""
    return queries.public_list(n, sort, page), queries.page_counts(queries.succeeded(n))


def notice(n: DataFrame, notice_id: int) -> DataFrame:
    """A notice as its page shows it, counted as viewed; append the view event to keep it."""
    return mutations.view(n, notice_id)


def categories(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(S.CATEGORIES.items()), "category string, description string")
    return rows.withColumn("label", label(rows["category"]))


def dashboard(n: DataFrame) -> dict[str, DataFrame]:
    return {"totals": metrics.dashboard(n), "categories": metrics.category_counts(n), "reasons": metrics.failure_reasons(n), "top": queries.top_liked(n), "feedback": metrics.feedback(n)}


def admin_content(n: DataFrame, sort: str | None = None, number: str | None = None, date: str | None = None) -> DataFrame:
    return queries.by_number(n, number, date).orderBy("id") if number else queries.admin_list(n, sort)


def edit_form(n: DataFrame, notice_id: int) -> DataFrame:
    return queries.by_id(n, notice_id)


def add(spark: SparkSession, path: str, run_date: str, run_ts: str, model: Model | None = None, extractor: files.Extractor = files.file_text, pattern: str = "*.pdf") -> DataFrame:
    """Notices of the uploaded files in a folder."""
    return ingest.ingest(files.extract_text(files.read_files(spark, path, pattern), extractor), run_date, run_ts, model)


def update(n: DataFrame, edits: DataFrame) -> DataFrame:
    return mutations.edit(n, edits)


def delete(n: DataFrame, notice_id: int) -> DataFrame:
    return mutations.delete_by_id(n, notice_id)


def post(n: DataFrame, notice_id: int, send: Callable[[str], None]) -> None:
    export.post_one(n, notice_id, send)


def export_all(n: DataFrame) -> DataFrame:
    return export.report_all(n)


def retry_failed(n: DataFrame, run_date: str, run_ts: str, model: Model | None = None) -> DataFrame:
    return ingest.retry(n, run_date, run_ts, model)


def thumbs(n: DataFrame, events: DataFrame) -> DataFrame:
    """Counters after votes and views, given as events."""
    return mutations.apply_events(n, events)


def run_scraper(pages: DataFrame, n: DataFrame) -> DataFrame:
    """Listings on stored archive pages that no notice comes from yet, with the file name each is kept under."""
    from lodestone.functions.text import archive_name

    new = listings.unseen(listings.latest_listing(pages), n)
    return new.withColumn("file_name", archive_name(new["gazette_number"], new["gazette_date"]))


def stop_processing(spark: SparkSession) -> bool:
    """End the running ingest; whether there was one."""
    return stop_ingest(spark)


def category(n: DataFrame, name: str, page: int = 1, sort: str | None = None) -> tuple[DataFrame, DataFrame]:
    return queries.category_list(n, name, sort, page), queries.page_counts(queries.in_category(n, name))


def batches(n: DataFrame) -> DataFrame:
    return queries.batch_has_failures(metrics.batch_rollup(n))


def delete_batch(n: DataFrame, path: str) -> DataFrame:
    return mutations.delete_batch(n, path)


def delete_bulk(n: DataFrame, ids: list[int]) -> DataFrame:
    if not ids:
        raise ValueError("no notices were selected")
    return mutations.delete_by_ids(n, n.sparkSession.createDataFrame([(i,) for i in ids], "id long"))


def export_batch(n: DataFrame, path: str) -> DataFrame:
    return export.report_batch(n, path)


def pdf_path(n: DataFrame, notice_id: int) -> DataFrame:
    """The stored file's path; no row where there is none."""
    return queries.with_path(queries.by_id(n, notice_id)).select("original_pdf_path")
