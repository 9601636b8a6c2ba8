"""The notices table, the items of the nine extraction schemas, and the values that stored rows hold."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

SUCCESS, FAILED = "SUCCESS", "FAILED"

# Categories in display order, with their descriptions.
CATEGORIES: dict[str, str] = {
    "Appointments": "Public service appointments and board changes.",
    "Legislation": "New acts, bills, and legislative supplements.",
    "Tenders": "Procurement notices and invitations to tender.",
    "Land_Property": "Land acquisition, disposal, and title deed notices.",
    "Court_Legal": "Probate, administration, and other court notices.",
    "Public_Service_HR": "Promotions, transfers, and HR notices.",
    "Licensing": "Applications and grants for various licenses.",
    "Company_Registrations": "Company incorporation and dissolution notices.",
    "Miscellaneous": "Other public notices and general information.",
}
DEFAULT_CATEGORY = "Miscellaneous"
FALLBACK_CATEGORY = "Uncategorized"

# Texts that failed and defaulted rows carry.
GENERATION_FAILED = "[GENERATION FAILED]"
PROCESSING_FAILED = "[PROCESSING FAILED]"
GENERATION_FAILED_TITLE = (GENERATION_FAILED + " ", " Notice (Review Extracted Data)")
PROCESSING_FAILED_TITLE = PROCESSING_FAILED + " Review Needed"
REASON_PREFIX = "The AI failed during processing. Reason: "
GENERATION_PREFIX = "AI failed to generate summary."
GENERATION_FAILED_SUMMARY = "AI failed to generate summary. Review extracted data below."
GENERATION_FAILED_ARTICLE = ("## Extracted Data (Generation Failed):\n\n```json\n", "\n```")
GENERATION_FAILED_ACTION = "Review needed"
PROCESSING_FAILED_X = "Processing error. Needs manual review."
PROCESSING_FAILED_ARTICLE = ("## AI PROCESSING FAILED\n\n**Reason:** ", "\n\nThe original text has been saved. You can try to fix it manually or use the 'Retry FAILED Notices' button.")
NULL_CONTENT = "Content was null."
UNTITLED, NO_SUMMARY = "Untitled Notice", "No summary provided."
REASON_NO_ITEMS = "Extraction failed: no 'items' wrapper"
REASON_EMPTY_ITEMS = "Extraction failed: 'items' was null or empty"
REASON_EMPTY_LIST = "Extraction failed: AI returned null or empty 'items'"
REASON_UNHANDLED = "Unhandled pipeline error"
UNKNOWN_REASON, REASON_GENERATION, UNKNOWN_FAILURE = "Unknown Reason", "Generation Failed", "Unknown Failure"

# The marker of a notice, and names that files and listings use.
NOTICE_MARKER = r"(?im)^GAZETTE NOTICE NO\.\s*\d+"
NOTICE_NUMBER = r"(?i)GAZETTE NOTICE NO\.\s*(\d+)"
LISTING_PREFIX = "Kenya Gazette "
ARCHIVE_NAME = ("Kenya_Gazette_", "_Dated_", ".pdf")
LISTING_LINK_PREFIX = "/akn/ke/officialGazette/"
DOWNLOAD_TEXT = "Download PDF"

DEFAULT_SIGNIFICANCE = 3
POST_SIGNIFICANCE = 8
PAGE_SIZE = 20
HEADER_CHARS, TRIAGE_CHARS, CELL_CHARS = 2000, 4000, 32000
X_SUMMARY_CHARS = 280

_S, _I = StringType(), IntegerType()

NOTICES = StructType(
    [
        StructField("id", LongType(), False),
        StructField("title", _S),
        StructField("category", _S),
        StructField("link", _S),
        StructField("notice_number", _S),
        StructField("signatory", _S),
        StructField("source_order", _I),
        StructField("gazette_volume", _S),
        StructField("gazette_number", _S),
        StructField("gazette_date", DateType()),
        StructField("content", _S),
        StructField("summary", _S),
        StructField("x_summary", _S),
        StructField("article", _S),
        StructField("actionable_info", _S),
        StructField("published_date", DateType()),
        StructField("system_published_at", TimestampNTZType()),
        StructField("last_updated_at", TimestampNTZType()),
        StructField("status", _S),
        StructField("original_pdf_path", _S),
        StructField("thumbs_up", LongType(), False),
        StructField("thumbs_down", LongType(), False),
        StructField("view_count", LongType(), False),
        StructField("significance_rating", _I, False),
    ]
)


def _item(fields: list[str], lists: list[str] | None = None) -> StructType:
    """Fields are strings, those in ``lists`` arrays of strings; all may be null."""
    return StructType([StructField(f, ArrayType(_S) if f in (lists or []) else _S) for f in fields])


# Item structure by category, keyed by the exact category name.
ITEMS: dict[str, StructType] = {
    "Appointments": _item(["person_name", "position", "agency", "effective_date", "appointment_type", "reference_number", "notice_id", "source_issue"]),
    "Legislation": _item(["title", "law_type", "citation", "enactment_date", "summary", "affected_sections", "notice_id", "source_issue"], lists=["affected_sections"]),
    "Tenders": _item(["tender_id", "procuring_entity", "brief_description", "deadline", "contact_info", "link_to_doc", "award_notice", "estimated_value"]),
    "Land_Property": _item(["parcel_id", "parties", "action_type", "location", "reference_docs", "valuation", "objection_period"], lists=["parties"]),
    "Court_Legal": _item(["court_name", "case_reference", "parties", "action_type", "filing_deadline", "judgment_summary"], lists=["parties"]),
    "Public_Service_HR": _item(["employee_name", "grade", "action", "effective_date", "department", "prior_position"]),
    "Licensing": _item(["licensee", "license_type", "regulator", "status", "issue_date", "expiry_date", "license_number"]),
    "Company_Registrations": _item(["company_name", "registration_action", "company_number", "effective_date", "directors", "notice_id"], lists=["directors"]),
    "Miscellaneous": _item(["notice_type", "brief_text", "contact_or_location", "date", "reference"]),
}
