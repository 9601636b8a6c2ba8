import datetime as dt
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import dates, jsonfix, text
from lodestone.operators.ingest import clean_category
from lodestone.operators.metrics import failure_reason


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("HDR\nGAZETTE NOTICE NO. 12\nA\n gazette notice no. 7\ngazette notice no.\n13\nB\n", ["GAZETTE NOTICE NO. 12\nA\n gazette notice no. 7", "gazette notice no.\n13\nB"]),
        ("GAZETTE NOTICE NO. 1\nA", ["GAZETTE NOTICE NO. 1\nA"]),
        ("  no marker here \n", ["  no marker here \n"]),
        (" \n\t ", []),
        ("", []),
        (None, None),
    ],
)
def test_segments(spark, given_text, expected):
    assert one(spark, given_text, text.segments) == expected


@pytest.mark.parametrize(("answer", "category"), [("Land Property!1", "Miscellaneous"), ("Land_Property.", "Land_Property"), (" Tenders\n", "Tenders"), (None, "Miscellaneous")])
def test_clean_category(spark, answer, category):
    assert one(spark, answer, clean_category) == category


def test_json_repair(spark):
    assert json.loads(one(spark, "{a: 1, b:[1,2,],}", jsonfix.safe_object)) == {"a": 1, "b": [1, 2]}
    prose = '{"article":"Apply by 3 May, venue: Nairobi"}'
    assert one(spark, prose, jsonfix.safe_object) == prose
    assert one(spark, prose, lambda c: jsonfix.safe_object(c, legacy=True)) is None
    assert json.loads(one(spark, 'x ```json\n{"a": "one\ntwo\tthree",}\n``` y', jsonfix.safe_object)) == {"a": "one\ntwo\tthree"}
    for bad in (None, "", "  ", "no object", "} {", "{nonsense"):
        assert one(spark, bad, jsonfix.safe_object) is None


def test_json_items(spark):
    assert one(spark, '{"items": null}', lambda c: jsonfix.has_key(c, "items")) is True
    assert one(spark, "{}", lambda c: jsonfix.has_key(c, "items")) is False
    assert [one(spark, j, jsonfix.kind_of) for j in ('{"a": 1}', "[1]", "null", "{}", "[]")] == ["OBJECT", "ARRAY", "VOID", "OBJECT", "ARRAY"]
    assert one(spark, "## text", jsonfix.object_or_array) is None


@pytest.mark.parametrize(("value", "day"), [("2025-01-05", dt.date(2025, 1, 5)), ("2025-1-5", None), ("2025-02-30", None), ("", None), (None, None)])
def test_iso_date(spark, value, day):
    assert one(spark, value, dates.iso_date) == day


def test_other_dates(spark):
    run, gaz = F.lit("2025-05-05").cast("date"), F.lit("2024-04-04").cast("date")
    assert one(spark, "7 November 2025", dates.long_date) == dt.date(2025, 11, 7)
    assert one(spark, "rubbish", lambda c: dates.published_date(c, gaz, run)) == dt.date(2025, 5, 5)
    assert one(spark, " ", lambda c: dates.published_date(c, gaz, run)) == dt.date(2024, 4, 4)
    assert one(spark, None, lambda c: dates.published_date(c, F.lit(None).cast("date"), run)) == dt.date(2025, 5, 5)
    for stamp, out in ((dt.datetime(2024, 1, 2, 3, 4), "2024-01-02T03:04"), (dt.datetime(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05"), (dt.datetime(2024, 1, 2, 3, 4, 0, 1000), "2024-01-02T03:04:00.001"), (dt.datetime(2024, 1, 2, 3, 4, 5, 10), "2024-01-02T03:04:05.000010")):
        assert one(spark, stamp, dates.iso_stamp_text, "timestamp_ntz") == out


def test_numbers(spark):
    assert [one(spark, v, lambda c: dates.int_or(c, 3)) for v in ("7.9", "x", None, "4")] == [7, 3, 3, 4]
    assert one(spark, 0, lambda c: dates.percentage(c, c), "long") == 0.0


def test_strings(spark):
    assert one(spark, "a" * 32001, text.truncate) == "a" * 32000 + "...[TRUNCATED]"
    assert one(spark, None, text.truncate) == ""
    assert one(spark, "\x00\t a \x1f", text.trim_ws) == "a"
    assert [one(spark, v, text.is_blank) for v in (None, "", "  \n", "x")] == [True, True, True, False]
    assert one(spark, "a\x00b", text.strip_nul) == "ab"
    assert one(spark, "/x/No 3.pdf", text.export_name) == "Export_No 3.csv"
    assert one(spark, "Kenya Gazette Vol. CXXVII No. 225", lambda c: text.archive_name(text.listing_number(c), F.lit(None).cast("date"))) == "Kenya_Gazette_Vol__CXXVII_No__225_Dated_Unknown_Date.pdf"
    assert one(spark, "x Gazette Notice No. 9 y", text.find_number) == "9"


@pytest.mark.parametrize(("summary", "reason"), [(None, "Unknown Reason"), ("The AI failed during processing. Reason: X", "X"), ("AI failed to generate summary. Z", "Generation Failed"), ("other", "Unknown Failure")])
def test_failure_reason(spark, summary, reason):
    assert one(spark, summary, failure_reason) == reason


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["GAZETTE NOTICE NO. 7\n", "words ", "\n", " gazette notice no. 8\n", "x"]), max_size=12))
def test_segments_are_pieces_in_order(spark, parts):
    whole = "".join(parts)
    at = 0
    for piece in one(spark, whole, text.segments):
        at = whole.index(piece, at) + len(piece)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text(st.characters(codec="utf-8", exclude_characters="`"), max_size=5), st.text(st.characters(codec="utf-8", exclude_characters="`"), max_size=10), max_size=4))
def test_repair_leaves_valid_objects(spark, value):
    raw = json.dumps(value)
    assert one(spark, raw, jsonfix.safe_object) == raw


def test_cut_and_trim_by_definition(spark):
    r = random.Random(3)
    texts = [None, "", *("".join(r.choices(["{", "}", " ", "\x00", "\n", " ", "a", "€", "```json", "```", "\U0001f600"], k=r.randrange(9))) for _ in range(600))]
    low = "".join(map(chr, range(33)))

    def cut(s):
        if s is None or not any(not x.isspace() for x in s):
            return None
        s = re.sub(r"(?sa)```json\s*(.*?)\s*```", r"\1", s).strip(low)
        lo, hi = s.find("{"), s.rfind("}")
        return s[lo : hi + 1] if 0 <= lo <= hi else None

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.trim_ws(F.col("t")).alias("trimmed"), jsonfix.cut_object(F.col("t")).alias("cut")).orderBy("k").collect()
    assert [x["trimmed"] for x in rows] == [None if t is None else t.strip(low) for t in texts]
    assert [x["cut"] for x in rows] == [cut(t) for t in texts]
