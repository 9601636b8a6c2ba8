"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by the pages of the host; lines above a boilerplate ratio are dropped
from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, private, read_table, written

#: A line goes if more than this share of its host's pages contain it ...
RATIO = 0.05
#: ... and at least so many pages do, so that small hosts lose nothing by chance.
MIN_PAGES = 5
#: Hosts with boilerplate that are broadcast; per host there are at most (distinct lines per page) / RATIO such lines.
BROADCAST_HOSTS = 5_000
BROADCAST_LINES = 100_000


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\x0c\r"))


def _key(line: Column) -> Column:
    return F.md5(_trimmed(line).cast("binary"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines to drop; ``line`` is the md5 of the line without white space around it.

    A page counts a line once however often it has it; what is shuffled is a count per host and line and map task.
    """
    slim = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _trimmed(x) != ""), _key))
    counts = slim.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    hosts = written(slim.groupBy("host").agg(F.count("*").alias("host_pages")), "hosts").withColumnRenamed("host", "h")
    return counts.join(broadcast_if_small(hosts, BROADCAST_LINES), F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > F.lit(ratio) * F.col("host_pages")).select("host", "line", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every input row with its text less the boilerplate lines of its host, plus ``n_lines`` and ``n_dropped``.

    Lines are the pieces between line feeds; lines without a word are never dropped and the others keep their order and
    spelling. A null text stays null with 0 lines, an empty one stays empty. A null host is a host of its own, repeated rows
    count as pages each, an empty table gives no rows. Other columns are kept, whatever their names; ``n_lines`` and
    ``n_dropped`` are replaced.

    The lines to drop go to each task by broadcast where few hosts have few of them; beyond that documents are joined by
    host in a shuffle, where AQE splits a hot host.
    """
    base = docs.drop("n_lines", "n_dropped")
    plan_at, mine_at, kept_at = private([*base.columns, "n_lines", "n_dropped"], "plan", "mine", "kept")
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    per_host = found.groupBy("host").agg(F.collect_list("line").alias("lines")).select(F.struct("host", "lines").alias(plan_at))
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        per_host = broadcast_if_small(per_host, BROADCAST_HOSTS)
    joined = base.join(per_host, F.col(host_col).eqNullSafe(F.col(plan_at)["host"]), "left")
    text, drop = F.col(text_col), F.col(plan_at)["lines"]
    marked = joined.withColumn(mine_at, F.when(drop.isNotNull(), F.array_intersect(F.transform(_lines(text), _key), drop)))
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(mine_at), _key(x)))
    hit = F.size(mine_at) > 0
    cut = marked.withColumn(kept_at, F.when(hit, kept))
    n_lines = F.when(text.isNotNull(), F.regexp_count(text, F.lit("\n")) + 1).otherwise(0).cast("long")
    n_dropped = F.when(hit, n_lines - F.size(kept_at)).otherwise(0).cast("long")
    shorter = F.when(hit, F.array_join(kept_at, "\n")).otherwise(text).alias(text_col)
    columns = (shorter if c == text_col else F.col(f"`{c}`") for c in base.columns)
    return cut.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents less the boilerplate lines of their source."""
    return drop_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP6_ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, line, i FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l),
p AS (SELECT source, t, count(DISTINCT doc_id) AS pages FROM k WHERE t <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
b AS (SELECT p.source, p.t FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * host_pages),
m AS (SELECT k.*, b.t IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.t = b.t),
s AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN s.text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped FROM documents d LEFT JOIN s USING (doc_id)
"""
