"""From document texts to notice rows: segment, classify, extract, repair, narrate, assemble.

Every step is a column; what goes wrong in a row becomes its failure reason and touches no other row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import dates, jsonfix, text
from lodestone.operators.model import Model, StubModel
from lodestone.operators.mutations import retry_merge
from lodestone.operators.queries import to_retry
from lodestone.sources.notices import conform


def segment(docs: DataFrame, text_col: str = "text", marker: str = S.NOTICE_MARKER) -> DataFrame:
    """One row per notice with its ``source_order`` from 1 and ``notice_text``; the other columns but the text are kept."""
    rest = [c for c in docs.columns if c != text_col]
    out = docs.select(*rest, F.posexplode(text.segments(F.col(text_col), marker)).alias("__pos", "notice_text"))
    return out.select(*rest, (F.col("__pos") + 1).cast("int").alias("source_order"), "notice_text")


def clean_category(answer: Column) -> Column:
    """A model's answer as one of the nine categories."""
    name = text.letters_only(answer)
    return F.when(name.isin(*S.CATEGORIES), name).otherwise(S.DEFAULT_CATEGORY)


def header_fields(header: Column) -> dict[str, Column]:
    """Volume, number and date of a header answer (JSON); null volume and number only without any header."""
    return {
        "gazette_volume": F.when(header.isNotNull(), jsonfix.string_or(header, "$.gazetteVolume", "")),
        "gazette_number": F.when(header.isNotNull(), jsonfix.string_or(header, "$.gazetteNumber", "")),
        "gazette_date": dates.iso_date(jsonfix.string_or(header, "$.gazetteDate", "")),
    }


def extraction_failure(wrapper: Column, items: Column) -> Column:
    """Why a row has nothing to assemble, or null. ``wrapper`` is the repaired answer, ``items`` what stands under that key."""

    def of(kind: Column) -> Column:
        first = F.when(kind == "ARRAY", jsonfix.kind_of(F.get_json_object(items, "$[0]")))
        return (
            F.when(~jsonfix.has_key(wrapper, "items"), S.REASON_NO_ITEMS)
            .when(items.isNull() | (kind == "VOID") | ((kind == "OBJECT") & (F.size(F.json_object_keys(items)) == 0)), S.REASON_EMPTY_ITEMS)
            .when((kind == "ARRAY") & (F.json_array_length(items) == 0), S.REASON_EMPTY_LIST)
            .when(~kind.isin("OBJECT", "ARRAY") | ((kind == "ARRAY") & (F.coalesce(first, F.lit("")) != "OBJECT")), S.REASON_UNHANDLED)
        )

    return text.let(jsonfix.kind_of(items), of)


def answers(segments: DataFrame, model: Model) -> DataFrame:
    """Add what the model says of each notice: category, wrapper, items, narrative (JSON texts)."""
    out = _asked(segments, "category", model.triage(F.col("notice_text")), clean_category)
    out = _asked(out, "wrapper", model.extract(F.col("notice_text"), F.col("category")), jsonfix.safe_object)
    out = out.withColumn("items", F.get_json_object("wrapper", "$.items"))
    out = _settled(out, "reason", extraction_failure(F.col("wrapper"), F.col("items")))
    return _narrated(out, model)


def _settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later filters read and don't work out again.

    A filter moves below the columns it reads and takes their expressions along, one copy for each mention; through columns made
    of one another, copies multiply. It doesn't move below a generator's output, here of one row for each.
    """
    rest = [c for c in rows.columns if c != name]
    return rows.withColumn("__value", value).select(*rest, F.inline(F.array(F.struct(F.col("__value").alias(name)))))


def _asked(rows: DataFrame, name: str, answer: Column, clean: Callable[[Column], Column]) -> DataFrame:
    """A model's answer in a column of its own, and then cleaned: it is asked for once, however often the cleaning names it."""
    return _settled(rows.withColumn("__answer", answer), name, clean(F.col("__answer"))).drop("__answer")


def _narrated(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with a reason have nothing to tell of: their items are null to the model, and so is their narrative."""
    good = F.when(F.col("reason").isNull(), F.col("items"))
    told = _asked(rows, "narrative", model.narrate(good, F.col("category")), jsonfix.safe_object)
    return told.withColumn("narrative", F.when(F.col("reason").isNull(), F.col("narrative")))


#: What assembly reads of a narrative and of an item.
_TOLD = "title string, summary string, xSummary string, article string, actionableInfo string, significance string"
_ITEM = "notice_id string, reference_number string, publication_date string, effective_date string, signatory string"


def assemble(rows: DataFrame, run_date: str, run_ts: str) -> DataFrame:
    """Notice rows out of ``answers`` with header fields and ``original_pdf_path``; one select, no UDF.

    A row with a reason becomes a fallback row; one without a narrative keeps its extracted data and fails too; the others
    succeed. The extracted JSON is also kept in ``extracted`` so that a retry can read it.
    """
    today, now = F.lit(run_date).cast("date"), F.lit(run_ts).cast("timestamp_ntz")
    rows = rows.withColumns({"__told": F.from_json("narrative", _TOLD), "__one": F.from_json(jsonfix.first_item(F.col("items")), _ITEM)})
    reason, nar, items, raw, one = F.col("reason"), F.col("__told"), F.col("items"), F.col("notice_text"), F.col("__one")
    bad, told = reason.isNotNull(), F.col("narrative").isNotNull()

    def said(name: str, default: Column | str) -> Column:
        return text.strip_nul(F.coalesce(nar[name], F.lit(default) if isinstance(default, str) else default))

    def pick(fallback: Column | str, success: Column, generation: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(bad, lit(fallback)).when(told, success).otherwise(lit(generation))

    number = F.coalesce(one["notice_id"], one["reference_number"], F.lit(""))
    number = F.when(number == "", text.find_number(raw)).otherwise(number)
    date = F.coalesce(one["publication_date"], one["effective_date"], F.lit(""))
    fb, ga, pa, ti = S.PROCESSING_FAILED_ARTICLE, S.GENERATION_FAILED_ARTICLE, S.REASON_PREFIX, S.GENERATION_FAILED_TITLE
    return rows.select(
        *[c for c in ("id", "doc_id") if c in rows.columns],
        pick(S.PROCESSING_FAILED_TITLE, said("title", S.UNTITLED), F.concat(F.lit(ti[0]), F.col("category"), F.lit(ti[1]))).alias("title"),
        F.when(bad, S.FALLBACK_CATEGORY).otherwise(F.col("category")).alias("category"),
        F.when(~bad, text.strip_nul(number)).alias("notice_number"),
        F.when(~bad, text.strip_nul(F.coalesce(one["signatory"], F.lit("")))).alias("signatory"),
        "source_order",
        "gazette_volume",
        "gazette_number",
        "gazette_date",
        F.coalesce(text.strip_nul(raw), F.lit(S.NULL_CONTENT)).alias("content"),
        pick(F.concat(F.lit(pa), reason), said("summary", S.NO_SUMMARY), S.GENERATION_FAILED_SUMMARY).alias("summary"),
        pick(S.PROCESSING_FAILED_X, said("xSummary", ""), "").alias("x_summary"),
        pick(F.concat(F.lit(fb[0]), reason, F.lit(fb[1])), said("article", items), F.concat(F.lit(ga[0]), text.strip_nul(items), F.lit(ga[1]))).alias("article"),
        F.when(bad, F.lit(None)).when(told, said("actionableInfo", "")).otherwise(S.GENERATION_FAILED_ACTION).alias("actionable_info"),
        F.when(bad, today).otherwise(dates.published_date(date, F.col("gazette_date"), today)).alias("published_date"),
        now.alias("system_published_at"),
        now.alias("last_updated_at"),
        F.when(~bad & told, S.SUCCESS).otherwise(S.FAILED).alias("status"),
        "original_pdf_path",
        F.when(bad, 0).when(told, dates.int_or(nar["significance"], S.DEFAULT_SIGNIFICANCE)).otherwise(S.DEFAULT_SIGNIFICANCE).alias("significance_rating"),
        items.alias("extracted"),
    )


def too_long(notices: DataFrame) -> DataFrame:
    """Rows whose short summary doesn't fit its column; these are stored as fallback rows instead."""
    return notices.where(F.length("x_summary") > S.X_SUMMARY_CHARS)


def checked(notices: DataFrame) -> DataFrame:
    """Turn rows with a short summary over 280 characters into fallback rows, as a refused save would."""
    over = F.coalesce(F.length("x_summary") > S.X_SUMMARY_CHARS, F.lit(False))
    fb = S.PROCESSING_FAILED_ARTICLE
    changed = {
        "title": F.lit(S.PROCESSING_FAILED_TITLE),
        "category": F.lit(S.FALLBACK_CATEGORY),
        "summary": F.lit(S.REASON_PREFIX + S.REASON_UNHANDLED),
        "article": F.lit(fb[0] + S.REASON_UNHANDLED + fb[1]),
        "status": F.lit(S.FAILED),
        "notice_number": F.lit(None),
        "signatory": F.lit(None),
        "actionable_info": F.lit(None),
        "significance_rating": F.lit(0),
        "x_summary": F.lit(S.PROCESSING_FAILED_X),
    }
    return notices.withColumn("__over", over).withColumns({c: F.when(F.col("__over"), v).otherwise(F.col(c)) for c, v in changed.items()}).drop("__over")


def ingest(docs: DataFrame, run_date: str, run_ts: str, model: Model | None = None, marker: str = S.NOTICE_MARKER) -> DataFrame:
    """Documents (``text``, ``original_pdf_path``) as notice rows without ids.

    A document with null text gives no rows. With a model that is not deterministic, write the result before using it twice.
    """
    model = model or StubModel()
    return notices_of(with_header(docs, model), run_date, run_ts, model, marker)


def with_header(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with volume, number and date of their issue."""
    headed = _asked(docs, "__h", model.header(F.col("text")), jsonfix.safe_object)
    header = F.when(~text.is_blank(F.col("text")), F.col("__h"))
    return headed.withColumns(header_fields(header)).drop("__h")


def notices_of(headed: DataFrame, run_date: str, run_ts: str, model: Model, marker: str = S.NOTICE_MARKER) -> DataFrame:
    """Notice rows of documents with header fields."""
    return checked(assemble(answers(segment(headed, marker=marker), model), run_date, run_ts))


def run(docs: DataFrame, path: str, run_date: str, run_ts: str, model: Model | None = None, marker: str = S.NOTICE_MARKER) -> DataFrame:
    """Ingest and write once; what is returned reads the written rows, so no answer is asked for twice."""
    ingest(docs, run_date, run_ts, model, marker).write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def regenerate(failed: DataFrame, run_date: str, run_ts: str, model: Model | None = None) -> DataFrame:
    """Second pass over failed rows: those with extracted data get a new narrative alone, the others are asked for anew."""
    model = model or StubModel()
    base = ["id", "notice_text", "source_order", "gazette_volume", "gazette_number", "gazette_date", "original_pdf_path"]
    rows = failed.withColumnRenamed("content", "notice_text")
    anew = answers(rows.where("extracted is null").select(*base), model)
    kept = rows.where("extracted is not null").select(*base, "category", F.col("extracted").alias("items"), F.lit(None).cast("string").alias("reason"))
    columns = [*base, "category", "items", "reason", "narrative"]
    return assemble(anew.select(*columns).unionByName(_narrated(kept, model).select(*columns)), run_date, run_ts)


def retry(notices: DataFrame, run_date: str, run_ts: str, model: Model | None = None) -> DataFrame:
    """The table after a retry of its failed rows; ``notices`` has ``extracted``."""
    return retry_merge(notices, regenerate(to_retry(notices), run_date, run_ts, model))


def deduplicate(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New notices whose issue (number, date) isn't stored; rows without a date are always new."""
    have = stored.where("gazette_date is not null").select("gazette_number", "gazette_date").distinct()
    return new.join(have, ["gazette_number", "gazette_date"], "left_anti").select(*new.columns)


def to_table(notices: DataFrame) -> DataFrame:
    return conform(notices)
