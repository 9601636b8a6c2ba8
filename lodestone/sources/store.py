"""A notices table that takes changes: numbered folders of rows, of which the newest of each id counts.

A change is written beside the table and then renamed to the next number, so readers see all of it or nothing, and of two
writers of the same number one fails and can try again. ``compact`` folds the changes into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestone import schema as S
from lodestone.operators.mutations import assign_ids
from lodestone.sources.notices import conform


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _changes(spark: SparkSession, table: str) -> list[int]:
    fs, at = _fs(spark, f"{table}/change=*")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(at) or [])


def _commit(rows: DataFrame, table: str, number: int) -> None:
    spark = rows.sparkSession
    staged = f"{table}/_staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, f"{table}/change={number:09}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise RuntimeError(f"change {number} of {table} was written by another")


def _next(spark: SparkSession, table: str) -> int:
    return max(_changes(spark, table), default=0) + 1


def merge(changed: DataFrame, table: str) -> None:
    """Insert or replace rows by id; other columns than those of the notices table are not kept."""
    _commit(conform(changed).withColumn("deleted", F.lit(False)), table, _next(changed.sparkSession, table))


def append(new: DataFrame, table: str) -> None:
    """Add rows under ids after the highest one."""
    spark = new.sparkSession
    after = current(spark, table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    merge(assign_ids(new, after), table)


def remove(ids: DataFrame, table: str) -> None:
    """Delete rows by id (column id); ids that are not there change nothing."""
    gone = conform(ids.select(F.col("id").cast("long").alias("id")).distinct()).withColumn("deleted", F.lit(True))
    _commit(gone, table, _next(ids.sparkSession, table))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The rows as they stand; of one folder they are read as they are, so filters reach the scan."""
    numbers = _changes(spark, table)
    if not numbers:
        return spark.createDataFrame([], S.NOTICES)
    rows = spark.read.schema(StructType([*S.NOTICES.fields, StructField("deleted", BooleanType())]))
    if len(numbers) == 1:
        return rows.parquet(f"{table}/change={numbers[0]:09}").where("not deleted").drop("deleted")
    read = rows.option("basePath", table).parquet(*(f"{table}/change={k:09}" for k in numbers))
    names = S.NOTICES.names
    newest = read.groupBy("id").agg(F.max_by(F.struct(*names, "deleted"), "change").alias("r"))
    return newest.where("not r.deleted").select(*(F.col(f"r.{c}").alias(c) for c in names))


def compact(spark: SparkSession, table: str) -> None:
    """Write the rows as they stand as one change, and delete the older ones; give it a table that nobody else writes."""
    old = _changes(spark, table)
    if len(old) > 1:
        _commit(current(spark, table).withColumn("deleted", F.lit(False)), table, old[-1] + 1)
        for k in old:
            fs, at = _fs(spark, f"{table}/change={k:09}")
            fs.delete(at, True)
