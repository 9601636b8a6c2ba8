"""Continuous ingest with Structured Streaming: files or texts in, notice rows out, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone import schema as S
from lodestone.operators.export import post_significant
from lodestone.operators.ingest import deduplicate, notices_of, with_header
from lodestone.operators.model import Model, StubModel
from lodestone.operators.mutations import COUNTERS, assign_ids
from lodestone.sources.files import Extractor, extract_text, file_text

INGEST = "notices-ingest"
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, landing: str, pattern: str = "*.pdf", per_trigger: int = 100) -> DataFrame:
    """New files of a landing folder; ``per_trigger`` bounds what one batch holds."""
    return spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(landing)


def start_ingest(
    files: DataFrame,
    table: str,
    checkpoint: str,
    run_date: str | Callable[[], str],
    run_ts: str | Callable[[], str],
    model: Model | None = None,
    extractor: Extractor = file_text,
    marker: str = S.NOTICE_MARKER,
    send: Callable[[str], None] | None = None,
    available_now: bool = True,
    name: str = INGEST,
) -> StreamingQuery:
    """Append the notices of new files to ``table``. A batch is one folder under it, named by its number, so a repeat overwrites itself.

    Files of an issue (number and date) that another batch has stored are passed over before the model sees their notices. Rows
    get ids after the highest stored one. ``run_date`` and ``run_ts`` may be functions: they are called for each batch. Posts go
    out after a batch's rows are written. ``available_now`` takes what is there and ends, as a scheduled run does. The query's
    name is its lock: a session has one ingest of a name at a time, and ``stop_ingest`` ends it.
    """
    model = model or StubModel()

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        day, now = (x() if callable(x) else x for x in (run_date, run_ts))
        staged = f"{table}/_staged/{number}"
        with_header(extract_text(df, extractor), model).write.mode("overwrite").parquet(f"{staged}-files")
        headed, old = spark.read.parquet(f"{staged}-files"), stored(spark, table, but=number)
        fresh = headed if old is None else deduplicate(headed, old)
        notices_of(fresh, day, now, model, marker).write.mode("overwrite").parquet(f"{staged}-rows")
        after = 0 if old is None else old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        at = f"{table}/batch={number}"
        assign_ids(spark.read.parquet(f"{staged}-rows"), after).write.mode("overwrite").parquet(at)
        for part in ("files", "rows"):
            _remove(spark, f"{staged}-{part}")
        if send is not None:
            post_significant(spark.read.parquet(at), send)

    writer = files.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def stop_ingest(spark: SparkSession, name: str = INGEST) -> bool:
    """Stop the running ingest of a name after its batch; whether there was one."""
    running = [q for q in spark.streams.active if q.name == name]
    for q in running:
        q.stop()
    return bool(running)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def stored(spark: SparkSession, table: str, but: int | None = None) -> DataFrame | None:
    """The rows of all batches, less those of one, or None before the first."""
    fs, at = _folder(spark, f"{table}/batch=*")
    found = [s.getPath() for s in fs.globStatus(at) or []]
    paths = [str(p) for p in found if p.getName() != f"batch={but}"]
    return spark.read.schema(S.NOTICES).parquet(*paths) if paths else None


def stream_counters(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Engagement per notice and window of an event stream (ts, user_id, event_type); state older than the watermark goes."""
    counted = (F.count_if(F.col("event_type") == k).alias(c) for k, c in COUNTERS.items())
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), F.col("user_id").alias("id")).agg(*counted).select(F.col("window.start").alias("start"), "id", *COUNTERS.values())
