"""Export: the report of nineteen columns, its files, and the webhook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.functions.hadoop import new_file
from lodestone.operators import workbook
from lodestone.operators.queries import by_id, by_path, official_order, posts

# The report's headers, in order.
HEADERS = ("ID", "Title", "Category", "Status", "Significance", "Notice #", "Gazette Date", "Gazette Vol", "Signatory", "Summary", "X-Summary", "Actionable Info", "Article (Full)", "Original Content", "Views", "Thumbs Up", "Thumbs Down", "Created At", "Last Updated")


def report(n: DataFrame) -> DataFrame:
    """Nineteen columns under their headers; null texts become empty, long ones are cut."""
    c = F.col
    values = [
        F.coalesce("id", F.lit(0).cast("long")),
        *(text.or_empty(c(x)) for x in ("title", "category", "status")),
        c("significance_rating"),
        text.or_empty(c("notice_number")),
        text.or_empty(dates.iso_date_text(c("gazette_date"))),
        *(text.or_empty(c(x)) for x in ("gazette_volume", "signatory")),
        *(text.truncate(c(x)) for x in ("summary", "x_summary", "actionable_info", "article", "content")),
        c("view_count"),
        c("thumbs_up"),
        c("thumbs_down"),
        *(text.or_empty(dates.iso_stamp_text(c(x))) for x in ("system_published_at", "last_updated_at")),
    ]
    return n.select(*(v.alias(h) for v, h in zip(values, HEADERS, strict=True)))


def report_all(n: DataFrame) -> DataFrame:
    return report(n.orderBy(*official_order()))


def report_batch(n: DataFrame, path: str) -> DataFrame:
    """The rows of one file, by id."""
    return report(by_path(n, path).orderBy("id"))


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report as CSV with a header (quotes doubled, line feeds kept inside them), as a workbook or as another format.

    ``xlsx`` makes one file, in the order of the rows: they pass through the driver, which holds one partition of them at a
    time. That is for what people download; other formats are folders that the executors write.
    """
    if fmt == "xlsx":
        with new_file(rows.sparkSession, path) as out:
            workbook.write(out, rows.columns, rows.toLocalIterator())
        return
    writer = rows.write.mode("overwrite")
    (writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def post_rows(rows: DataFrame, send: Callable[[str], None]) -> None:
    """Send each ``x_summary`` on the executors; ``send`` takes the text, and an error of one is swallowed like a lost post.

    Spark may run a task again, after a lost executor for instance, and its posts then go out again: a receiver that must not
    see a post twice has to drop repeats.
    """

    def each(part):
        for r in part:
            try:
                send(r["x_summary"])
            except Exception as e:  # noqa: BLE001 - a webhook that is down must not undo the batch
                print(f"post failed: {e}")

    rows.select("x_summary").foreachPartition(each)


def post_one(n: DataFrame, notice_id: int, send: Callable[[str], None]) -> None:
    """Post one notice by hand, whatever its significance."""
    post_rows(by_id(n, notice_id), send)


def post_significant(n: DataFrame, send: Callable[[str], None]) -> None:
    """Post what ``posts`` selects; give it committed rows."""
    post_rows(posts(n), send)
