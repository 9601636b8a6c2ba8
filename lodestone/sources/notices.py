"""Where notices come from: a stored table, or a deterministic view of the test tables in the shape of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """A stored notices table; the schema is declared, so nothing is inferred and columns are pruned at the scan."""
    return spark.read.schema(S.NOTICES).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A notices table in a database; the caller gives the url, credentials and partitioning."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def conform(df: DataFrame) -> DataFrame:
    """Cast to the notices table, fill missing columns with null and counters with 0, and drop other columns."""
    have = set(df.columns)
    cols = []
    for f in S.NOTICES.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((c if f.nullable or f.name == "id" else F.coalesce(c, F.lit(0))).alias(f.name))
    return df.select(*cols)


def sample_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices made from ``documents``, ``labels`` and ``events``: one per document, none dropped.

    Events are counted per user before they are joined, so neither join multiplies rows.
    """
    docs, labels, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "events"))
    counts = events.groupBy(F.col("user_id").alias("id")).agg(*(F.count_if(F.col("event_type") == t).cast("int").alias(n) for t, n in (("view", "views"), ("click", "ups"), ("error", "downs"))))
    bad = labels.select(F.col("doc_id").alias("id"), "quality")
    d = docs.withColumnRenamed("doc_id", "id").join(bad, "id", "left").join(counts, "id", "left")
    i = F.col("id")
    failed = F.coalesce(F.col("quality") == 0, F.lit(False))
    generation = i % 2 == 0  # the two kinds of failure alternate
    status = F.when(failed, S.FAILED).otherwise(S.SUCCESS)
    before, after = S.GENERATION_FAILED_TITLE
    title = F.when(failed & generation, F.concat(F.lit(before), F.col("lang"), F.lit(after))).when(failed, S.PROCESSING_FAILED_TITLE).otherwise(F.concat(F.lit("Notice "), i.cast("string")))
    reason = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, S.REASON_PREFIX + S.REASON_NO_ITEMS).when(i % 4 == 2, S.GENERATION_FAILED_SUMMARY).otherwise("Other failure")
    stamp = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, id % 1000 + 0.5 * (id % 2))")
    out = d.select(
        i,
        title.alias("title"),
        F.col("lang").alias("category"),
        F.lit(None).cast("string").alias("link"),
        F.concat(F.lit("NO-"), (i % 500).cast("string")).alias("notice_number"),
        F.when(i % 3 == 0, "Registrar").alias("signatory"),
        (i % 50 + 1).cast("int").alias("source_order"),
        F.lit("Vol. I").alias("gazette_volume"),
        F.col("source").alias("gazette_number"),
        F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int"))).alias("gazette_date"),
        F.col("text").alias("content"),
        F.when(failed, reason).otherwise(F.substring("text", 1, 80)).alias("summary"),
        F.substring("text", 1, 60).alias("x_summary"),
        F.concat(F.lit("{\"notice_id\": \""), i.cast("string"), F.lit("\"}")).alias("article"),
        F.when(failed, S.GENERATION_FAILED_ACTION).otherwise("").alias("actionable_info"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("published_date"),
        stamp.alias("system_published_at"),
        stamp.alias("last_updated_at"),
        status.alias("status"),
        F.when(i % 13 != 0, F.concat(F.lit("/store/"), F.col("source"), F.lit(".pdf"))).alias("original_pdf_path"),
        F.coalesce("ups", F.lit(0)).alias("thumbs_up"),
        F.coalesce("downs", F.lit(0)).alias("thumbs_down"),
        F.coalesce("views", F.lit(0)).alias("view_count"),
        (i % 10 + 1).cast("int").alias("significance_rating"),
    )
    return out


#: The same view as SQL, to be put before an oracle's own text.
SAMPLE_SQL = f"""WITH ev AS (SELECT user_id AS id, count_if(event_type = 'view')::INT AS views, count_if(event_type = 'click')::INT AS ups, count_if(event_type = 'error')::INT AS downs FROM events GROUP BY user_id),
base AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, coalesce(l.quality = 0, false) AS failed, views, ups, downs FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN ev ON ev.id = d.doc_id),
notices AS (SELECT id,
  CASE WHEN failed AND id % 2 = 0 THEN '{S.GENERATION_FAILED_TITLE[0]}' || lang || '{S.GENERATION_FAILED_TITLE[1]}' WHEN failed THEN '{S.PROCESSING_FAILED_TITLE}' ELSE 'Notice ' || id END AS title,
  lang AS category, NULL::VARCHAR AS link, 'NO-' || (id % 500) AS notice_number, CASE WHEN id % 3 = 0 THEN 'Registrar' END AS signatory,
  (id % 50 + 1)::INT AS source_order, 'Vol. I' AS gazette_volume, source AS gazette_number,
  CASE WHEN id % 17 <> 0 THEN DATE '2024-01-01' + (id % 30)::INT END AS gazette_date, text AS content,
  CASE WHEN NOT failed THEN substr(text, 1, 80) WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '{S.REASON_PREFIX}{S.REASON_NO_ITEMS.replace("'", "''")}' WHEN id % 4 = 2 THEN '{S.GENERATION_FAILED_SUMMARY}' ELSE 'Other failure' END AS summary,
  substr(text, 1, 60) AS x_summary, '{{"notice_id": "' || id || '"}}' AS article, CASE WHEN failed THEN '{S.GENERATION_FAILED_ACTION}' ELSE '' END AS actionable_info,
  DATE '2024-01-01' + (id % 30)::INT AS published_date,
  TIMESTAMP '2024-02-01 00:00:00' + to_milliseconds((id % 1000) * 1000 + 500 * (id % 2)) AS system_published_at,
  TIMESTAMP '2024-02-01 00:00:00' + to_milliseconds((id % 1000) * 1000 + 500 * (id % 2)) AS last_updated_at,
  CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN id % 13 <> 0 THEN '/store/' || source || '.pdf' END AS original_pdf_path,
  coalesce(ups, 0)::INT AS thumbs_up, coalesce(downs, 0)::INT AS thumbs_down, coalesce(views, 0)::INT AS view_count, (id % 10 + 1)::INT AS significance_rating FROM base)
"""
