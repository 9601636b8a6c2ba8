"""Aggregations over notices. Each is one partial and one final aggregation, over the few columns that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.dates import percentage
from lodestone.operators.queries import failed, succeeded, with_category, with_path


def batch_rollup(n: DataFrame) -> DataFrame:
    """Per file, date and number: notices and failed ones, newest issue first; the number sorts by code point."""
    rolled = with_path(n).groupBy("original_pdf_path", "gazette_date", "gazette_number").agg(F.count("*").alias("notice_count"), F.sum(F.when(F.col("status") == S.FAILED, 1).otherwise(0)).alias("failed_count"))
    return rolled.orderBy(F.col("gazette_date").desc_nulls_first(), F.col("gazette_number").desc_nulls_first(), F.col("original_pdf_path"))


def _totals() -> list[Column]:
    ok, total = F.count_if(F.col("status") == S.SUCCESS), F.count("*")
    return [total.alias("total"), F.count_if(F.col("status") == S.FAILED).alias("failed"), ok.alias("successful"), percentage(ok.cast("double"), total).alias("success_rate")]


def _engagement() -> list[Column]:
    def summed(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == S.SUCCESS, F.col(name))), F.lit(0)).cast("long")

    views, ups, downs = summed("view_count"), summed("thumbs_up"), summed("thumbs_down")
    return [views.alias("views"), ups.alias("thumbs_up"), downs.alias("thumbs_down"), (views + ups + downs).alias("engagement")]


def kpi_totals(n: DataFrame) -> DataFrame:
    """One row: total, failed, successful and the success rate in percent, 0.0 for no rows."""
    return n.agg(*_totals())


def engagement(n: DataFrame) -> DataFrame:
    """One row of sums over published notices, 0 for none."""
    return n.agg(*_engagement())


def dashboard(n: DataFrame) -> DataFrame:
    """Totals and engagement in one pass."""
    return n.agg(*_totals(), *_engagement())


def failure_reason(summary: Column) -> Column:
    return F.when(summary.isNull(), S.UNKNOWN_REASON).when(summary.startswith(S.REASON_PREFIX), F.replace(summary, F.lit(S.REASON_PREFIX), F.lit(""))).when(summary.startswith(S.GENERATION_PREFIX), S.REASON_GENERATION).otherwise(S.UNKNOWN_FAILURE)


def failure_reasons(n: DataFrame) -> DataFrame:
    return failed(n).groupBy(failure_reason(F.col("summary")).alias("reason")).agg(F.count("*").alias("notices"))


def status_split(n: DataFrame) -> DataFrame:
    return n.groupBy("status").agg(F.count("*").alias("notices"))


def counter_sums(n: DataFrame, *names: str) -> DataFrame:
    """One row of the sums of counters, as longs."""
    return n.agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in names))


def category_counts(n: DataFrame) -> DataFrame:
    return with_category(succeeded(n)).groupBy("category").agg(F.count("*").alias("notices"))


def feedback(n: DataFrame) -> DataFrame:
    """The two bars of the feedback chart."""
    return engagement(n).select(F.explode(F.array(F.struct(F.lit("Thumbs Up").alias("label"), F.col("thumbs_up").alias("votes")), F.struct(F.lit("Thumbs Down").alias("label"), F.col("thumbs_down").alias("votes")))).alias("x")).select("x.label", "x.votes")
