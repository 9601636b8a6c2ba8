"""Every registered query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import dates, jsonfix, text
from lodestone.functions.batches import small_batches
from lodestone.operators import export, ingest, metrics, mutations, queries
from lodestone.sources import listings
from lodestone.sources.notices import SAMPLE_SQL, sample_notices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_LIST = ", ".join(queries.LIST_COLUMNS)
#: No test document holds the real marker, so lines that begin with an article stand for notices there.
SAMPLE_MARKER = r"(?im)^the\s"
_MARK = r"(?im)^(the\s)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, for queries that read them over Arrow batches."""
    small_batches(spark)
    return _table(spark, sf_dir, "pages")


def _put(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _on_notices(name: str, f: Callable[[DataFrame], DataFrame], sql: str, columns: list[str] | None = queries.LIST_COLUMNS) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(sample_notices(spark, sf_dir))
        return out.select(*columns) if columns else out

    _put(name, query, f"{SAMPLE_SQL}{sql}")


def _list(where: str = "true", order: str = "", tail: str = "") -> str:
    return f"SELECT {_LIST} FROM notices WHERE {where} {'ORDER BY ' + order if order else ''} {tail}"


_OK = "status = 'SUCCESS'"
_OFFICIAL = "gazette_date DESC NULLS FIRST, source_order ASC NULLS LAST, id ASC"
_POPULAR = "view_count DESC NULLS FIRST, gazette_date DESC NULLS FIRST, id DESC"
_VIEWED = "view_count DESC NULLS FIRST, id DESC"
_SIGNIFICANT = "significance_rating DESC NULLS FIRST, id DESC"

# ---- filters and projections
_on_notices("f1_succeeded", queries.succeeded, _list(_OK))
_on_notices("f2_failed", queries.failed, _list("status = 'FAILED'"))
_on_notices("f3_in_category", lambda n: queries.in_category(n, "en"), _list(f"category = 'en' AND {_OK}"))
_on_notices("f4_by_number", lambda n: queries.by_number(n, "src3"), _list("gazette_number = 'src3'"))
_on_notices("f4_by_number_and_date", lambda n: queries.by_number(n, "src3", "2024-01-04"), _list("gazette_number = 'src3' AND gazette_date = DATE '2024-01-04'"))
_on_notices("f5_issue_exists", lambda n: queries.first_of_issue(n, "src3", "2024-01-04"), "SELECT DISTINCT gazette_number, gazette_date FROM notices WHERE gazette_number = 'src3' AND gazette_date = DATE '2024-01-04'", ["gazette_number", "gazette_date"])
_on_notices("f6_by_path", lambda n: queries.by_path(n, "/store/src7.pdf"), _list("original_pdf_path = '/store/src7.pdf'"))
_on_notices("f7_with_path", queries.with_path, _list("original_pdf_path IS NOT NULL"))
_on_notices("f8_by_id", lambda n: queries.by_id(n, 42), _list("id = 42"))
_on_notices("f9_status_split", metrics.status_split, "SELECT status, count(*) AS notices FROM notices GROUP BY status", None)
_on_notices("f10_liked", queries.liked, _list("thumbs_up > 0"))
_on_notices("f11_with_category", queries.with_category, _list("category IS NOT NULL"))
_on_notices("f12_significance_badge", lambda n: n.select("id", queries.is_significant().alias("badge")), "SELECT id, significance_rating >= 8 AS badge FROM notices", None)
_on_notices("f13_posts", queries.posts, f"SELECT id, x_summary FROM notices WHERE {_OK} AND significance_rating >= 8", None)
_on_notices("f14_retryable", queries.retryable, _list("status = 'FAILED' AND (starts_with(title, '[GENERATION FAILED]') OR starts_with(title, '[PROCESSING FAILED]'))"))
_on_notices("f14_generation_failures", queries.generation_failures, _list("status = 'FAILED' AND starts_with(title, '[GENERATION FAILED]')"))

# ---- orders, limits, pages
_PAGE = "LIMIT 20 OFFSET {}"
_on_notices("o1_official", lambda n: n.orderBy(*queries.official_order()), _list(order=_OFFICIAL))
_on_notices("o2_official_failed", lambda n: queries.failed(n).orderBy(*queries.official_order()), _list("status = 'FAILED'", _OFFICIAL))
_on_notices("o3_official_page", lambda n: queries.page(queries.succeeded(n), queries.official_order(), 2), _list(_OK, _OFFICIAL, _PAGE.format(20)))
_on_notices("o4_official_category_page", lambda n: queries.category_list(n, "en", "official", 2), _list(f"category = 'en' AND {_OK}", _OFFICIAL, _PAGE.format(20)))
_on_notices("o5_popular_page", lambda n: queries.public_list(n, "popular", 1), _list(_OK, _POPULAR, _PAGE.format(0)))
_on_notices("o6_significant_page", lambda n: queries.public_list(n, "significant", 1), _list(_OK, _SIGNIFICANT, _PAGE.format(0)))
_on_notices("o7_recent_page", lambda n: queries.public_list(n, None, 3), _list(_OK, "id DESC", _PAGE.format(40)))
_on_notices("o8_category_recent_page", lambda n: queries.category_list(n, "fr"), _list(f"category = 'fr' AND {_OK}", "id DESC", _PAGE.format(0)))
_on_notices("o9_category_popular_page", lambda n: queries.category_list(n, "de", "popular"), _list(f"category = 'de' AND {_OK}", _VIEWED, _PAGE.format(0)))
_on_notices("o10_category_significant_page", lambda n: queries.category_list(n, "es", "significant"), _list(f"category = 'es' AND {_OK}", _SIGNIFICANT, _PAGE.format(0)))
_on_notices("o11_admin_popular", lambda n: queries.admin_list(n, "popular"), _list(order=_VIEWED))
_on_notices("o12_admin_significant", lambda n: queries.admin_list(n, "significant"), _list(order=_SIGNIFICANT))
_on_notices("o13_admin_recent", queries.admin_list, _list(order="id DESC"))
_on_notices("o15_top_liked", queries.top_liked, _list(f"{_OK} AND thumbs_up > 0", f"thumbs_up DESC, {_OFFICIAL}", "LIMIT 3"))
_on_notices("l2_page_counts", lambda n: queries.page_counts(queries.succeeded(n)), f"SELECT count(*) AS total_elements, ceil(count(*) / 20)::BIGINT AS total_pages FROM notices WHERE {_OK}", None)
_on_notices("l4_public_default", lambda n: queries.public_list(n, "anything"), _list(_OK, "id DESC", _PAGE.format(0)))
_on_notices("l5_category_default", lambda n: queries.category_list(n, "en", "anything", 2), _list(f"category = 'en' AND {_OK}", "id DESC", _PAGE.format(20)))
_on_notices("l6_admin_official", lambda n: queries.admin_list(n, "oldest"), _list(order=_OFFICIAL))

# ---- aggregations
_ROLLUP = "SELECT original_pdf_path, gazette_date, gazette_number, count(*) AS notice_count, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed_count FROM notices WHERE original_pdf_path IS NOT NULL GROUP BY ALL"
_TOTALS = "count(*) AS total, count_if(status = 'FAILED')::BIGINT AS failed, count_if(status = 'SUCCESS')::BIGINT AS successful, CASE WHEN count(*) > 0 THEN count_if(status = 'SUCCESS')::DOUBLE / count(*) * 100 ELSE 0 END AS success_rate"
_SUMS = f"coalesce(sum(view_count) FILTER ({_OK}), 0)::BIGINT AS views, coalesce(sum(thumbs_up) FILTER ({_OK}), 0)::BIGINT AS thumbs_up, coalesce(sum(thumbs_down) FILTER ({_OK}), 0)::BIGINT AS thumbs_down, (coalesce(sum(view_count) FILTER ({_OK}), 0) + coalesce(sum(thumbs_up) FILTER ({_OK}), 0) + coalesce(sum(thumbs_down) FILTER ({_OK}), 0))::BIGINT AS engagement"
_on_notices("a1_batch_rollup", metrics.batch_rollup, _ROLLUP, None)
_on_notices("o14_batch_order", metrics.batch_rollup, f"{_ROLLUP} ORDER BY gazette_date DESC NULLS FIRST, gazette_number DESC NULLS FIRST, original_pdf_path", None)
_on_notices("f15_batch_projection", lambda n: metrics.batch_rollup(n).select("original_pdf_path", "notice_count"), f"SELECT original_pdf_path, notice_count FROM ({_ROLLUP})", None)
_on_notices("f16_batch_has_failures", lambda n: queries.batch_has_failures(metrics.batch_rollup(n)), f"SELECT *, failed_count > 0 AS has_failures FROM ({_ROLLUP})", None)
_on_notices("a2_kpi_totals", metrics.kpi_totals, f"SELECT {_TOTALS} FROM notices", None)
_on_notices("a3_engagement", metrics.engagement, f"SELECT {_SUMS} FROM notices", None)
_on_notices("a23_dashboard", metrics.dashboard, f"SELECT {_TOTALS}, {_SUMS} FROM notices", None)
_REASON = f"CASE WHEN summary IS NULL THEN 'Unknown Reason' WHEN starts_with(summary, '{S.REASON_PREFIX}') THEN replace(summary, '{S.REASON_PREFIX}', '') WHEN starts_with(summary, '{S.GENERATION_PREFIX}') THEN 'Generation Failed' ELSE 'Unknown Failure' END"
_on_notices("a4_failure_reasons", metrics.failure_reasons, f"SELECT {_REASON} AS reason, count(*) AS notices FROM notices WHERE status = 'FAILED' GROUP BY 1", None)
_on_notices("a5_category_counts", metrics.category_counts, f"SELECT category, count(*) AS notices FROM notices WHERE {_OK} AND category IS NOT NULL GROUP BY category", None)
_on_notices("a6_top_articles", lambda n: queries.top_liked(n, 3), _list(f"{_OK} AND thumbs_up > 0", f"thumbs_up DESC, {_OFFICIAL}", "LIMIT 3"))
_on_notices("a7_feedback", metrics.feedback, f"SELECT 'Thumbs Up' AS label, coalesce(sum(thumbs_up), 0)::BIGINT AS votes FROM notices WHERE {_OK} UNION ALL SELECT 'Thumbs Down', coalesce(sum(thumbs_down), 0)::BIGINT FROM notices WHERE {_OK}", None)

# ---- changes
_W = ["id", "title", "link", "status", "thumbs_up", "thumbs_down", "view_count", "gazette_number"]


def _labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice with a toxic label gets another title and a link."""
    n = sample_notices(spark, sf_dir)
    edits = n.join(_labelled_ids(spark, sf_dir), "id").select("id", F.concat(F.lit("Edited "), F.col("title")).alias("title"), F.lit("https://example.org/").alias("link"))
    return mutations.edit(n, edits).select(*_W)


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice with a toxic label has a later version."""
    n = sample_notices(spark, sf_dir)
    return mutations.latest(n, n.join(_labelled_ids(spark, sf_dir), "id").select(*n.columns).withColumn("title", F.lit("Later"))).select("id", "title")


def _regenerated(n: DataFrame) -> DataFrame:
    return queries.failed(n).withColumns({"title": F.lit("Again"), "status": F.lit(S.SUCCESS), "gazette_number": F.lit(None).cast("string")})


_on_notices("w1_delete_by_id", lambda n: mutations.delete_by_id(n, 42), _list("id <> 42"))
_put("w2_delete_by_ids", lambda s, d: mutations.delete_by_ids(sample_notices(s, d), _labelled_ids(s, d)).select(*queries.LIST_COLUMNS), f"{SAMPLE_SQL}{_list('id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)')}")
_on_notices("w3_delete_batch", lambda n: mutations.delete_batch(n, "/store/src5.pdf"), _list("original_pdf_path IS DISTINCT FROM '/store/src5.pdf'"))
_TOXIC = "id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_put("w4_edit", _edited, f"{SAMPLE_SQL}SELECT id, CASE WHEN {_TOXIC} THEN 'Edited ' || title ELSE title END AS title, CASE WHEN {_TOXIC} THEN 'https://example.org/' END AS link, status, thumbs_up, thumbs_down, view_count, gazette_number FROM notices")
_put(
    "w5_apply_events",
    lambda s, d: mutations.apply_events(sample_notices(s, d), _table(s, d, "events")).select("id", "view_count", "thumbs_up", "thumbs_down"),
    f"{SAMPLE_SQL}SELECT id, (view_count * 2)::BIGINT AS view_count, (thumbs_up * 2)::BIGINT AS thumbs_up, (thumbs_down * 2)::BIGINT AS thumbs_down FROM notices",
)
_on_notices("w6_view", lambda n: mutations.view(n, 42), "SELECT id, (view_count + 1)::BIGINT AS view_count FROM notices WHERE id = 42", ["id", "view_count"])
_on_notices("w7_retry_merge", lambda n: mutations.retry_merge(n, _regenerated(n)), "SELECT id, CASE WHEN status = 'FAILED' THEN 'Again' ELSE title END AS title, link, 'SUCCESS' AS status, thumbs_up, thumbs_down, view_count, gazette_number FROM notices", _W)
_put("k1_latest_version", _later, f"{SAMPLE_SQL}SELECT id, CASE WHEN {_TOXIC} THEN 'Later' ELSE title END AS title FROM notices")

# ---- scans and sinks
_put("s10_scan", lambda s, d: _table(s, d, "documents").select("doc_id", "source", "n_chars"), "SELECT doc_id, source, n_chars FROM documents")
_put(
    "s4_page_links",
    lambda s, d: listings.all_links(_pages(s, d)).groupBy("page_id").agg(F.count("*").alias("links"), F.min_by("href", "pos").alias("first_href")),
    r"""SELECT page_id, len(h)::BIGINT AS links, h[1] AS first_href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages) WHERE len(h) > 0""",
)
_put(
    "s6_resolve_url",
    lambda s, d: listings.all_links(_pages(s, d)).where(F.col("href").startswith("/")).groupBy("page_id").agg(F.min_by("url", "pos").alias("first_url")),
    r"""SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*') || h[1] AS first_url FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: starts_with(x, '/')) AS h FROM pages) WHERE len(h) > 0""",
)
_put("s7_file_identifier", lambda s, d: _table(s, d, "pages").select("page_id", text.file_identifier(F.col("url")).alias("identifier")), "SELECT page_id, replace(string_split(url, '/')[-1], '.pdf', '') AS identifier FROM pages")
_put(
    "p15_unseen",
    lambda s, d: listings.unseen(sample_notices(s, d).select("gazette_number", F.col("published_date").alias("gazette_date")), queries.by_number(sample_notices(s, d), "src3")),
    f"{SAMPLE_SQL}SELECT DISTINCT gazette_number, published_date AS gazette_date FROM notices n WHERE NOT EXISTS (SELECT 1 FROM notices o WHERE o.gazette_number = 'src3' AND o.gazette_number = n.gazette_number AND o.gazette_date = n.published_date)",
)
_CELL = "CASE WHEN length({0}) > 32000 THEN substr({0}, 1, 32000) || '...[TRUNCATED]' ELSE coalesce({0}, '') END"
_STAMP = "regexp_replace(regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%g'), '\\.000$', ''), '^(.{{16}}):00$', '\\1')"
_REPORT = (
    'SELECT id AS "ID", coalesce(title, \'\') AS "Title", coalesce(category, \'\') AS "Category", coalesce(status, \'\') AS "Status", significance_rating AS "Significance", coalesce(notice_number, \'\') AS "Notice #", coalesce(gazette_date::VARCHAR, \'\') AS "Gazette Date", coalesce(gazette_volume, \'\') AS "Gazette Vol", coalesce(signatory, \'\') AS "Signatory", '
    + ", ".join(f'{_CELL.format(c)} AS "{h}"' for c, h in (("summary", "Summary"), ("x_summary", "X-Summary"), ("actionable_info", "Actionable Info"), ("article", "Article (Full)"), ("content", "Original Content")))
    + ', view_count AS "Views", thumbs_up AS "Thumbs Up", thumbs_down AS "Thumbs Down", '
    + ", ".join(f'coalesce({_STAMP.format(c)}, \'\') AS "{h}"' for c, h in (("system_published_at", "Created At"), ("last_updated_at", "Last Updated")))
    + " FROM notices"
)
_on_notices("k3_report", export.report, _REPORT, None)
_on_notices("k4_report_all", export.report_all, _REPORT, None)
_on_notices("k5_report_batch", lambda n: export.report_batch(n, "/store/src9.pdf"), f"{_REPORT} WHERE original_pdf_path = '/store/src9.pdf'", None)
_on_notices("k2_archive_name", lambda n: n.select("id", text.archive_name(F.col("gazette_number"), F.col("gazette_date")).alias("name")), "SELECT id, 'Kenya_Gazette_' || regexp_replace(gazette_number, '[^a-zA-Z0-9]', '_', 'g') || '_Dated_' || coalesce(gazette_date::VARCHAR, 'Unknown_Date') || '.pdf' AS name FROM notices", None)
_on_notices("k6_posts_by_id", lambda n: queries.by_id(n, 42).select("id", "x_summary"), "SELECT id, x_summary FROM notices WHERE id = 42", None)
_on_notices("k7_pdf_path", lambda n: queries.with_path(queries.by_id(n, 42)).select("id", "original_pdf_path"), "SELECT id, original_pdf_path FROM notices WHERE id = 42 AND original_pdf_path IS NOT NULL", None)

# ---- strings, dates, numbers


def _on_documents(name: str, columns: dict[str, Callable[[], object]], sql: str) -> None:
    _put(name, lambda s, d: _table(s, d, "documents").select("doc_id", *(f().alias(c) for c, f in columns.items())), f"SELECT doc_id, {sql} FROM documents")


_T = lambda: F.col("text")


def _digest(c):
    """Whole texts compare by their digests, so that rows stay small."""
    return F.md5(c.cast("binary"))


_on_documents("t1_find_all", {"matches": lambda: F.size(text.find_all(_T(), r"(?i)\bthe\b"))}, r"len(regexp_extract_all(text, '(?i)\bthe\b'))::INT AS matches")
_on_documents("t2_capture", {"word": lambda: text.find_number(_T(), r"(?i)the ([a-z]+)")}, "regexp_extract(text, '(?i)the ([a-z]+)', 1) AS word")
_on_documents("t3_letters_only", {"letters": lambda: _digest(text.letters_only(_T()))}, "md5(regexp_replace(text, '[^a-zA-Z_]', '', 'g')) AS letters")
_on_documents("t4_strip_fence", {"body": lambda: _digest(text.strip_fence(F.concat(F.lit("```json\n"), _T(), F.lit("\n```"))))}, r"md5(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS body")
_on_documents("t5_literal_replace", {"clean": lambda: _digest(text.without(text.strip_nul(_T()), "the"))}, "md5(replace(text, 'the', '')) AS clean")
_on_documents("t6_prefix", {"hit": lambda: text.has_prefix(_T(), "The ")}, "starts_with(text, 'The ') AS hit")
_on_documents("t7_head", {"triage": lambda: F.md5(text.head(_T(), S.TRIAGE_CHARS).cast("binary"))}, "md5(substr(text, 1, 4000)) AS triage")
_on_documents("t8_truncate", {"n": lambda: F.length(text.truncate(_T(), 1000))}, "CASE WHEN length(text) > 1000 THEN 1014 ELSE length(text) END::INT AS n")
_on_documents("t10_trim", {"trimmed": lambda: F.md5(text.trim_ws(_T()).cast("binary"))}, r"md5(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS trimmed")
_on_documents("t11_blank", {"blank": lambda: text.is_blank(_T())}, r"coalesce(NOT regexp_matches(text, '[^\s\pZ]'), true) AS blank")
_on_documents("t13_listing_number", {"number": lambda: text.listing_number(F.concat(F.lit(S.LISTING_PREFIX), F.col("source"), F.lit(" ")))}, "source AS number")
_on_documents("t14_label", {"label": lambda: text.label(F.concat_ws("_", "lang", "source"))}, "lang || ' ' || source AS label")
_on_documents("t15_lower", {"low": lambda: _digest(text.lowered(_T()))}, "md5(lower(text)) AS low")
_on_documents("t16_contains", {"hit": lambda: text.has_part(_T(), "token")}, "contains(text, 'token') AS hit")
_on_notices("t9_or_empty", lambda n: n.select("id", text.or_empty(F.col("signatory")).alias("signatory")), "SELECT id, coalesce(signatory, '') AS signatory FROM notices", None)
_on_notices("t12_safe_name", lambda n: n.select("id", text.archive_name(F.concat(F.lit("Vol. "), F.col("gazette_number")), F.col("gazette_date")).alias("name")), "SELECT id, 'Kenya_Gazette_Vol__' || gazette_number || '_Dated_' || coalesce(gazette_date::VARCHAR, 'Unknown_Date') || '.pdf' AS name FROM notices", None)
_on_notices("t17_export_name", lambda n: n.select("id", text.export_name(F.col("original_pdf_path")).alias("name")), "SELECT id, 'Export_' || replace(string_split(original_pdf_path, '/')[-1], '.pdf', '') || '.csv' AS name FROM notices", None)
_on_notices("t18_or_label", lambda n: n.select("id", text.or_label(F.col("signatory")).alias("signatory")), "SELECT id, coalesce(signatory, 'N/A') AS signatory FROM notices", None)
_on_notices("d1_iso_date", lambda n: n.select("id", dates.iso_date(F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 35).cast("string"), 2, "0"))).alias("day")), "SELECT id, try_cast('2024-02-' || lpad((id % 35)::VARCHAR, 2, '0') AS DATE) AS day FROM notices", None)
_on_notices("d2_long_date", lambda n: n.select("id", dates.long_date(F.concat((F.col("id") % 28 + 1).cast("string"), F.lit(" March 2024"))).alias("day")), "SELECT id, DATE '2024-03-01' + (id % 28)::INT AS day FROM notices", None)
_on_notices(
    "d3_published_date",
    lambda n: n.select("id", dates.published_date(F.when(F.col("id") % 3 == 0, "2024-05-06").when(F.col("id") % 3 == 1, "not a date").otherwise(" "), F.col("gazette_date"), F.lit("2025-01-01").cast("date")).alias("day")),
    "SELECT id, CASE id % 3 WHEN 0 THEN DATE '2024-05-06' WHEN 1 THEN DATE '2025-01-01' ELSE coalesce(gazette_date, DATE '2025-01-01') END AS day FROM notices",
    None,
)
_on_notices("d5_year", lambda n: n.groupBy(dates.year_of(F.col("published_date")).alias("year")).agg(F.count("*").alias("notices")), "SELECT year(published_date)::INT AS year, count(*) AS notices FROM notices GROUP BY 1", None)
_on_notices("d7_display", lambda n: n.select("id", dates.short_stamp(F.col("system_published_at")).alias("short"), dates.full_date(F.col("gazette_date")).alias("full")), "SELECT id, strftime(system_published_at, '%b %-d, %-I:%M %p') AS short, strftime(gazette_date, '%B %-d, %Y') AS full FROM notices", None)
_on_notices("d8_iso_text", lambda n: n.select("id", dates.iso_stamp_text(F.col("system_published_at")).alias("stamp")), f"SELECT id, {_STAMP.format('system_published_at')} AS stamp FROM notices", None)
_on_notices("m1_percentage", lambda n: n.groupBy("category").agg(F.round(dates.percentage(F.count_if(F.col("status") == S.FAILED).cast("double"), F.count("*")), 6).alias("failed_share")), "SELECT category, round(count_if(status = 'FAILED')::DOUBLE / count(*) * 100, 6) AS failed_share FROM notices GROUP BY category", None)
_on_notices("m2_rate_text", lambda n: n.groupBy("gazette_number").agg(dates.rate_text(F.avg("significance_rating") * 10).alias("rate")), "SELECT gazette_number, printf('%.1f%%', avg(significance_rating) * 10) AS rate FROM notices GROUP BY 1", None)
_on_notices("m3_int_or", lambda n: n.select("id", dates.int_or(F.when(F.col("id") % 2 == 0, F.concat((F.col("id") % 10).cast("string"), F.lit(".9"))).otherwise("x"), 3).alias("n")), "SELECT id, CASE WHEN id % 2 = 0 THEN id % 10 ELSE 3 END::INT AS n FROM notices", None)
_on_notices("m4_counter_sums", lambda n: metrics.counter_sums(n, "view_count", "thumbs_up", "thumbs_down"), "SELECT sum(view_count)::BIGINT AS view_count, sum(thumbs_up)::BIGINT AS thumbs_up, sum(thumbs_down)::BIGINT AS thumbs_down FROM notices", None)

# ---- JSON


def _on_events(name: str, columns: dict[str, Callable[[], object]], sql: str) -> None:
    _put(name, lambda s, d: _table(s, d, "events").select("event_id", *(f().alias(c) for c, f in columns.items())), f"SELECT event_id, {sql} FROM events")


_P = lambda: F.col("props")
_on_events("j1_safe_object", {"k": lambda: F.get_json_object(jsonfix.safe_object(F.concat(F.lit("answer: ```json\n"), _P(), F.lit("\n``` done"))), "$.k")}, "json_extract_string(props, '$.k') AS k")
_on_events("j2_common_repair", {"k": lambda: F.get_json_object(jsonfix.safe_object(F.replace(F.replace(_P(), F.lit('"k"'), F.lit("k")), F.lit("}"), F.lit(",}"))), "$.k")}, "json_extract_string(props, '$.k') AS k")
_on_events("j3_control_repair", {"t": lambda: F.get_json_object(jsonfix.safe_object(F.concat(F.lit('{"t": "a\n'), F.col("event_type"), F.lit('"}'))), "$.t")}, "'a' || chr(10) || event_type AS t")
_on_events("j4_string_or", {"k": lambda: jsonfix.string_or(_P(), "$.k", "none"), "missing": lambda: jsonfix.string_or(_P(), "$.q", "none")}, "coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing")
_on_events("j5_int_or", {"k": lambda: dates.int_or(F.get_json_object(_P(), "$.k"), 3)}, "coalesce(json_extract_string(props, '$.k')::INT, 3) AS k")
_on_events("j6_has_key", {"k": lambda: jsonfix.has_key(_P(), "k"), "q": lambda: jsonfix.has_key(_P(), "q")}, "json_exists(props, '$.k') AS k, false AS q")
_on_events("j7_kind_of", {"kind": lambda: jsonfix.kind_of(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), _P(), F.lit("]"))).otherwise(_P()))}, "CASE WHEN event_id % 2 = 0 THEN 'ARRAY' ELSE 'OBJECT' END AS kind")
_on_events("j8_first_item", {"k": lambda: F.get_json_object(jsonfix.first_item(jsonfix.items_array(_P())), "$.k")}, "json_extract_string(props, '$.k') AS k")
_on_events("j9_serialise", {"k": lambda: F.get_json_object(jsonfix.serialise(F.col("event_type").alias("k")), "$.k")}, "event_type AS k")
_on_events("j10_object_or_array", {"good": lambda: jsonfix.object_or_array(F.when(F.col("event_id") % 2 == 0, F.lit("## text")).otherwise(_P())).isNotNull()}, "event_id % 2 <> 0 AS good")

# ---- ingest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/store/"), F.col("source"), F.lit(".pdf")).alias("original_pdf_path"))


_SEGMENTS = rf"""WITH cut AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(regexp_replace(text, '{_MARK}', chr(30) || '\1', 'g'), chr(30)), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
kept AS (SELECT doc_id, source, text, CASE WHEN len(p) > 0 AND NOT regexp_matches(p[1], '(?i)^the\s') THEN p[2:] ELSE p END AS p FROM cut),
whole AS (SELECT doc_id, source, CASE WHEN len(p) = 0 AND regexp_matches(text, '[^\s\pZ]') THEN [text] ELSE p END AS p FROM kept),
seg AS (SELECT doc_id, source, unnest(p) AS notice_text, generate_subscripts(p, 1)::INT AS source_order FROM whole)
"""
_put("p2_segment", lambda s, d: ingest.segment(_documents(s, d), marker=SAMPLE_MARKER).select("doc_id", "source_order", F.md5(F.col("notice_text").cast("binary")).alias("digest")), f"{_SEGMENTS}SELECT doc_id, source_order, md5(notice_text) AS digest FROM seg")


def _triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.model import StubModel

    hints = {"Tenders": ("tion",), "Land_Property": ("ung",), "Court_Legal": ("eux",)}
    model = StubModel(hints)
    return _table(spark, sf_dir, "documents").select("doc_id", ingest.clean_category(model.triage(F.col("text"))).alias("category"))


_put("p5_triage", _triage, "SELECT doc_id, CASE WHEN contains(lower(substr(text, 1, 4000)), 'tion') THEN 'Tenders' WHEN contains(lower(substr(text, 1, 4000)), 'ung') THEN 'Land_Property' WHEN contains(lower(substr(text, 1, 4000)), 'eux') THEN 'Court_Legal' ELSE 'Miscellaneous' END AS category FROM documents")
_put(
    "p1_ingest",
    lambda s, d: ingest.ingest(_documents(s, d), "2025-01-01", "2025-01-01 00:00:00", marker=SAMPLE_MARKER).select("doc_id", "source_order", "title", "category", "status", "notice_number", _digest(F.col("summary")).alias("summary"), "published_date", "significance_rating", "original_pdf_path", F.md5(F.col("content").cast("binary")).alias("digest")),
    f"""{_SEGMENTS}SELECT doc_id, source_order, category || ' notice' AS title, category, 'SUCCESS' AS status, regexp_extract(notice_text, '(?i)GAZETTE NOTICE NO\\.\\s*(\\d+)', 1) AS notice_number, md5(notice_text) AS summary, DATE '2025-01-01' AS published_date, (length(notice_text) % 10 + 1)::INT AS significance_rating, '/store/' || source || '.pdf' AS original_pdf_path, md5(notice_text) AS digest
FROM (SELECT *, CASE WHEN regexp_matches(substr(notice_text, 1, 4000), '(?i)(sealed tender|quotation for|supply and delivery)') THEN 'Tenders' WHEN regexp_matches(substr(notice_text, 1, 4000), '(?i)(parcel of land|land registrar|plot number)') THEN 'Land_Property' WHEN regexp_matches(substr(notice_text, 1, 4000), '(?i)(high court|estate of the late|petitioner)') THEN 'Court_Legal' WHEN regexp_matches(substr(notice_text, 1, 4000), '(?i)(companies act|registrar of companies|struck off the register)') THEN 'Company_Registrations' ELSE 'Miscellaneous' END AS category FROM seg)""",
)


def _fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose extraction failed in each of the ways there are, by document id."""
    i = F.col("doc_id") % 6
    wrapper = F.when(i == 0, F.lit(None)).when(i == 1, '{"a": 1}').when(i == 2, '{"items": null}').when(i == 3, '{"items": {}}').when(i == 4, '{"items": []}').otherwise('{"items": [1]}')
    rows = _table(spark, sf_dir, "documents").select("doc_id", wrapper.alias("w"))
    return rows.select("doc_id", ingest.extraction_failure(F.col("w"), F.get_json_object("w", "$.items")).alias("reason"))


_put("p9_failure_reason", _fallbacks, """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Extraction failed: no ''items'' wrapper' WHEN 1 THEN 'Extraction failed: no ''items'' wrapper' WHEN 2 THEN 'Extraction failed: ''items'' was null or empty' WHEN 3 THEN 'Extraction failed: ''items'' was null or empty' WHEN 4 THEN 'Extraction failed: AI returned null or empty ''items''' ELSE 'Unhandled pipeline error' END AS reason FROM documents""")


def _retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.retry(sample_notices(spark, sf_dir).withColumn("extracted", F.when(F.col("id") % 2 == 0, F.col("article"))), "2025-01-01", "2025-01-01 00:00:00").select("id", "title", "status", "gazette_number")


_put("p10_retry", _retry, f"{SAMPLE_SQL}SELECT id, CASE WHEN status = 'SUCCESS' THEN title WHEN id % 2 = 0 THEN category || ' notice' ELSE 'Miscellaneous notice' END AS title, 'SUCCESS' AS status, gazette_number FROM notices")


# ---- archive pages, made in the shape of listings from the ids of the test pages


def _archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    row = lambda n, day: F.concat(F.lit('<tr><td class="cell-title"><a href="/akn/ke/officialGazette/'), n, F.lit('">Kenya Gazette No. '), n, F.lit("</a></td><td>"), day, F.lit(" November 2025</td></tr>"))
    day = (F.col("page_id") % 28 + 1).cast("string")
    html = F.concat(F.lit("<table>"), row(i, day), row(F.lit("0"), F.lit("1")), F.lit('</table><a href="get/'), i, F.lit('.pdf">Download PDF</a>'))
    return _pages(spark, sf_dir).select("page_id", html.alias("html"), F.lit("https://law.example.org/list/2025").alias("url"))


_put(
    "s4_latest_listing",
    lambda s, d: listings.latest_listing(_archive_pages(s, d)).select("page_id", "url", "gazette_number"),
    "SELECT page_id, 'https://law.example.org/akn/ke/officialGazette/' || page_id AS url, 'No. ' || page_id AS gazette_number FROM pages",
)
_put("s5_row_date", lambda s, d: listings.latest_listing(_archive_pages(s, d)).select("page_id", "gazette_date"), "SELECT page_id, DATE '2025-11-01' + (page_id % 28)::INT AS gazette_date FROM pages")
_put("s4_download_link", lambda s, d: listings.download_link(_archive_pages(s, d)), "SELECT page_id, 'https://law.example.org/list/get/' || page_id || '.pdf' AS url FROM pages")
_put(
    "s4_content_type",
    lambda s, d: _table(s, d, "pages").select("page_id", listings.is_pdf(F.when(F.col("page_id") % 2 == 0, "application/pdf; x").when(F.col("page_id") % 3 == 0, "text/html")).alias("pdf")),
    "SELECT page_id, page_id % 2 = 0 AS pdf FROM pages",
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two texts of a file: the vision text of page 1 and the rest, or the plain text where that is blank."""
    from lodestone.sources.files import high_fidelity

    vision = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, " ")
    best = high_fidelity(vision, F.lit("rest"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.when(text.is_blank(best), F.col("text")).otherwise(best).cast("binary")).alias("digest"))


_put("s3_text_fallback", _texts, "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 AND regexp_matches(text, '[^\\s\\pZ]') THEN text || chr(10) || chr(10) || 'rest' ELSE text END) AS digest FROM documents")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    header = F.when(i % 3 == 0, F.concat(F.lit('{"gazetteVolume": "Vol. I", "gazetteNumber": "No. '), i.cast("string"), F.lit('", "gazetteDate": "2024-03-05"}'))).when(i % 3 == 1, '{"gazetteDate": "5th March", "gazetteNumber": null}')
    return _table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in ingest.header_fields(header).items()))


_put(
    "p3_header_fields",
    _headers,
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Vol. I' WHEN 1 THEN '' END AS gazette_volume, CASE doc_id % 3 WHEN 0 THEN 'No. ' || doc_id WHEN 1 THEN '' END AS gazette_number, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-03-05' END AS gazette_date FROM documents",
)


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly of rows with a narrative, without one, and with a reason."""
    i = F.col("doc_id")
    items = F.concat(F.lit('[{"reference_number": "R'), i.cast("string"), F.lit('", "effective_date": "2024-02-03"}]'))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("notice_text"),
        F.lit(1).alias("source_order"),
        F.lit("Vol. I").alias("gazette_volume"),
        F.lit("No. 1").alias("gazette_number"),
        F.lit("2024-01-01").cast("date").alias("gazette_date"),
        F.lit("/p.pdf").alias("original_pdf_path"),
        F.lit("Tenders").alias("category"),
        items.alias("items"),
        F.when(i % 3 == 2, S.REASON_NO_ITEMS).alias("reason"),
        F.when(i % 3 == 0, F.lit('{"title": "T", "significance": 9}')).alias("narrative"),
    )
    done = ingest.assemble(rows, "2025-01-01", "2025-01-01 00:00:00")
    return done.select("doc_id", "title", "category", "notice_number", "summary", "x_summary", "actionable_info", "published_date", "status", "significance_rating", F.md5(F.col("article").cast("binary")).alias("article"))


_ITEMS = """'[{"reference_number": "R' || doc_id || '", "effective_date": "2024-02-03"}]'"""
_put(
    "p8_assemble",
    _assembled,
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN '[GENERATION FAILED] Tenders Notice (Review Extracted Data)' ELSE '[PROCESSING FAILED] Review Needed' END AS title,
CASE WHEN doc_id % 3 = 2 THEN 'Uncategorized' ELSE 'Tenders' END AS category, CASE WHEN doc_id % 3 <> 2 THEN 'R' || doc_id END AS notice_number,
CASE doc_id % 3 WHEN 0 THEN 'No summary provided.' WHEN 1 THEN 'AI failed to generate summary. Review extracted data below.' ELSE 'The AI failed during processing. Reason: Extraction failed: no ''items'' wrapper' END AS summary,
CASE WHEN doc_id % 3 = 2 THEN 'Processing error. Needs manual review.' ELSE '' END AS x_summary, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Review needed' END AS actionable_info,
CASE WHEN doc_id % 3 = 2 THEN DATE '2025-01-01' ELSE DATE '2024-02-03' END AS published_date, CASE WHEN doc_id % 3 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE doc_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 0 END::INT AS significance_rating,
md5(CASE doc_id % 3 WHEN 0 THEN {_ITEMS} WHEN 1 THEN '## Extracted Data (Generation Failed):' || chr(10) || chr(10) || '```json' || chr(10) || {_ITEMS} || chr(10) || '```' ELSE '## AI PROCESSING FAILED' || chr(10) || chr(10) || '**Reason:** Extraction failed: no ''items'' wrapper' || chr(10) || chr(10) || 'The original text has been saved. You can try to fix it manually or use the ''Retry FAILED Notices'' button.' END) AS article FROM documents""",
)
_put("p7_narrative", lambda s, d: _narratives(s, d), "SELECT doc_id, 'Tenders notice' AS title, md5(text) AS summary FROM documents")


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.model import StubModel

    items = F.to_json(F.struct(F.col("text").alias("brief_text")))
    told = StubModel().narrate(items, F.lit("Tenders"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(told, "$.title").alias("title"), _digest(F.get_json_object(told, "$.summary")).alias("summary"))


def _item_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read into the structure of their category, whether one object or an array was given."""
    from pyspark.sql.types import ArrayType

    i = F.col("doc_id")
    one = F.concat(F.lit('{"court_name": "C'), i.cast("string"), F.lit('", "parties": ["a", "b"]}'))
    given = F.when(i % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    read = F.from_json(jsonfix.items_array(given), ArrayType(S.ITEMS["Court_Legal"]))
    return _table(spark, sf_dir, "documents").select("doc_id", read[0]["court_name"].alias("court_name"), F.size(read[0]["parties"]).alias("parties"))


_put("s9_item_structs", _item_structs, "SELECT doc_id, 'C' || doc_id AS court_name, 2 AS parties FROM documents")
_put("c1_categories", lambda s, d: s.createDataFrame([(k, v) for k, v in S.CATEGORIES.items()], "category string, description string"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.CATEGORIES.items()) + ") t(category, description)")
