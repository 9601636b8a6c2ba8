"""Changes to a notices table. A frame goes in and the changed frame comes out; storage is base files plus later versions.

Counters are kept as append-only events and added up when read, so no update is lost and nothing is locked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDITABLE = ("title", "summary", "article", "x_summary", "actionable_info", "link")
RETRY_FIELDS = ("title", "summary", "article", "actionable_info", "x_summary", "notice_number", "signatory", "published_date", "gazette_volume", "gazette_number", "gazette_date", "category", "content")
COUNTERS = {"view": "view_count", "click": "thumbs_up", "error": "thumbs_down"}


def delete_by_id(n: DataFrame, notice_id: int) -> DataFrame:
    return n.where(F.col("id") != notice_id)


def delete_by_ids(n: DataFrame, ids: DataFrame) -> DataFrame:
    """Less the rows whose id is in ``ids`` (column id)."""
    return n.join(ids.select("id").distinct(), "id", "left_anti").select(*n.columns)


def delete_batch(n: DataFrame, path: str) -> DataFrame:
    """Less the rows of one file; rows without a path stay. Files are not touched."""
    return n.where(F.coalesce(F.col("original_pdf_path") != path, F.lit(True)))


def edit(n: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrite the editable columns that ``edits`` (id and some of them, one row per id) supplies; status stays."""
    cols = [c for c in EDITABLE if c in edits.columns]
    e = edits.select("id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in cols))
    joined = n.join(e, "id", "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in cols}).select(*n.columns)


def count_events(events: DataFrame, id_col: str = "user_id", kind_col: str = "event_type") -> DataFrame:
    """(id, one column per counter) from engagement events; combined per task before the shuffle."""
    return events.groupBy(F.col(id_col).alias("id")).agg(*(F.count_if(F.col(kind_col) == k).alias(c) for k, c in COUNTERS.items()))


def apply_events(n: DataFrame, events: DataFrame, id_col: str = "user_id", kind_col: str = "event_type") -> DataFrame:
    """Counters, as longs, plus new events; rows without an event keep theirs."""
    added = count_events(events, id_col, kind_col).select("id", *(F.col(c).alias(f"__{c}") for c in COUNTERS.values()))
    joined = n.join(added, "id", "left")
    return joined.withColumns({c: (F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).cast("long") for c in COUNTERS.values()}).select(*n.columns)


def view(n: DataFrame, notice_id: int) -> DataFrame:
    """The row of an id as it reads after one more view; no row where the id is absent. The view itself is an event to append."""
    return n.where(F.col("id") == notice_id).withColumn("view_count", F.col("view_count").cast("long") + 1)


def retry_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace failed rows by regenerated ones (by id): thirteen fields and the status.

    Volume, number and date that the new row lacks stay as they were; rating, order, path and counters are the old row's.
    """
    fresh = new.where(F.col("status") == "SUCCESS").select("id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in RETRY_FIELDS))
    joined = old.join(fresh, "id", "left")
    keep = ("gazette_volume", "gazette_number", "gazette_date")
    changed = {c: F.when(F.col("__hit"), F.coalesce(F.col(f"__{c}"), F.col(c)) if c in keep else F.col(f"__{c}")).otherwise(F.col(c)) for c in RETRY_FIELDS}
    return joined.withColumns(changed | {"status": F.when(F.col("__hit"), "SUCCESS").otherwise(F.col("status"))}).select(*old.columns)


def latest(base: DataFrame, delta: DataFrame, version_col: str = "last_updated_at") -> DataFrame:
    """One row per id out of stored rows and later versions: the newest; of equally new ones that of ``delta``."""
    both = base.withColumn("__from", F.lit(0)).unionByName(delta.withColumn("__from", F.lit(1)))
    newest = both.groupBy("id").agg(F.max_by(F.struct(*base.columns), F.struct(F.col(version_col), F.col("__from"))).alias("r"))
    return newest.select("r.*")


def assign_ids(new: DataFrame, after: int) -> DataFrame:
    """Ids for a batch of new rows, from ``after`` + 1, by issue, file and place in it.

    The window takes one batch of arrivals, not the table; the order gives ids their meaning of arrival.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.col("gazette_date").asc_nulls_last(), F.col("original_pdf_path").asc_nulls_last(), F.col("source_order").asc_nulls_last(), F.xxhash64("content"))
    return new.withColumn("id", (F.row_number().over(order) + F.lit(after)).cast("long"))
