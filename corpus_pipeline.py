"""The corpus pipeline: from ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept, whole texts included. Between
stages the rows are written as Parquet and read again, so a lost executor costs the stage that runs and nothing before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, line_dedup, mixing, ngram_join, packing
from lodestone.llm.common import small_batches, written

#: A text is in none of the learned languages if its code is longer than the text itself, and few of its bytes are such as the
#: language has: at most 0.38 in random letters, 0.44 or more in prose with keys and numbers in it.
MAX_BITS, MIN_KNOWN = 8.0, 0.4
#: Ids of dropped documents that are broadcast; beyond that they are matched in a shuffle.
BROADCAST_IDS = 1_000_000


#: The columns of ``documents`` that stages use; all others pass through under any name.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def _passing(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` with the columns that no stage uses under plain names, and the result under the old ones."""
    inner = docs.toDF(*(c if c in USED else f"other_{k}" for k, c in enumerate(docs.columns)))
    return stage(inner).select(*inner.columns).toDF(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach, with ``lang`` as predicted.

    Rejected: a null text, one without a letter, and one that every model finds random, as a whole and in most of its bytes; a
    text with keys, numbers or marks between its words stays. An empty input stays empty.
    """
    small_batches(spark)

    def stage(docs: DataFrame) -> DataFrame:
        told = language_id.identify(docs, language_id.train(docs))
        kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("lang_bits") <= MAX_BITS) | (F.col("lang_known") >= MIN_KNOWN)))
        return kept.withColumn("lang", F.col("lang_pred"))

    return _passing(docs, stage)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that their source repeats; ``n_chars`` follows the text. None is dropped."""

    def stage(docs: DataFrame) -> DataFrame:
        out = line_dedup.drop_boilerplate(docs)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return out

    return _passing(docs, stage)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows that share an id are one document.

    Documents without a word, and rows without an id, are in no group and stay.
    """
    small_batches(spark)

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    def stage(docs: DataFrame) -> DataFrame:
        groups = written(ngram_join.components_of(docs), "groups")
        gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
        again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        kept = docs.join(small(gone), "doc_id", "left_anti")
        if again.isEmpty():
            return kept
        again = small(written(again, "again"))
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return kept.join(again, "doc_id", "left_anti").unionByName(once)

    return _passing(docs, stage)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: each document as often as its source's rate says, from not at all to three times."""
    return _passing(docs, lambda docs: mixing.repeat_copies(mixing.mix(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two; ``ids`` are little-endian unsigned 32-bit."""
    small_batches(spark)
    packed = packing.pack(docs)
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Languages, near duplicates and token ids have no SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
