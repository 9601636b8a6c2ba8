import datetime as dt
import json
import re
import tracemalloc
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone import schema as S
from lodestone.functions.hadoop import new_file
from lodestone.operators import export, ingest, metrics, mutations, queries, workbook
from lodestone.operators.model import CallModel, StubModel, patient
from lodestone.sources import files, listings, store
from lodestone.sources.notices import conform, read_notices, sample_notices

from .conftest import SF

DAY, NOW = "2025-05-05", "2025-05-05 06:07:08"


def notices(spark, rows):
    base = {"title": None, "status": "SUCCESS", "view_count": 0, "thumbs_up": 0, "thumbs_down": 0, "significance_rating": 0}
    full = [{f.name: (base | r).get(f.name) for f in S.NOTICES.fields} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], S.NOTICES)


def test_pages_are_the_whole_sort(spark):
    n = notices(spark, [{"id": i, "view_count": i % 3, "gazette_date": None if i % 4 == 0 else dt.date(2024, 1, 1 + i % 5)} for i in range(45)])
    whole = [r["id"] for r in n.orderBy(*queries.popular_order()).collect()]
    pages = [r["id"] for p in (1, 2, 3, 4) for r in queries.public_list(n, "popular", p).collect()]
    assert pages == whole
    assert queries.page_counts(n).first() == (45, 3)
    with pytest.raises(ValueError, match="numbered"):
        queries.page(n, queries.recent_order(), 0)


def test_null_dates_come_first(spark):
    n = notices(spark, [{"id": 1, "gazette_date": dt.date(2024, 1, 1), "source_order": None}, {"id": 2, "gazette_date": None}, {"id": 3, "gazette_date": dt.date(2024, 1, 1), "source_order": 5}])
    assert [r["id"] for r in n.orderBy(*queries.official_order()).collect()] == [2, 3, 1]


def test_empty_table(spark):
    n = notices(spark, [])
    assert metrics.kpi_totals(n).first() == (0, 0, 0, 0.0)
    assert metrics.engagement(n).first() == (0, 0, 0, 0)
    assert metrics.batch_rollup(n).count() == metrics.failure_reasons(n).count() == queries.top_liked(n).count() == 0


def test_rollup_counts_every_row_with_a_path(spark):
    n = sample_notices(spark, SF)
    assert metrics.batch_rollup(n).agg(F.sum("notice_count")).first()[0] == queries.with_path(n).count()


def test_changes(spark):
    n = notices(spark, [{"id": 1, "title": "a", "link": "x", "gazette_number": "7"}, {"id": 2, "title": "b", "status": "FAILED", "gazette_number": "8"}])
    edited = {r["id"]: (r["title"], r["link"]) for r in mutations.edit(n, spark.createDataFrame([(1, "z")], "id long, title string")).collect()}
    assert edited == {1: ("z", "x"), 2: ("b", None)}
    new = notices(spark, [{"id": 2, "title": "c", "gazette_number": None}])
    merged = {r["id"]: (r["title"], r["status"], r["gazette_number"]) for r in mutations.retry_merge(n, new).collect()}
    assert merged == {1: ("a", "SUCCESS", "7"), 2: ("c", "SUCCESS", "8")}
    assert [r["id"] for r in mutations.assign_ids(notices(spark, [{"id": 0, "content": "x"}, {"id": 0, "content": "y"}]), 10).orderBy("id").collect()] == [11, 12]
    assert mutations.delete_batch(n, "/nowhere").count() == 2
    with pytest.raises(ValueError, match="selected"):
        api.delete_bulk(n, [])
    assert [r["id"] for r in api.delete_bulk(n, [1]).collect()] == [2]


class Scripted:
    """A model that answers with what the text holds after a tag."""

    def header(self, text):
        return F.lit('{"gazetteVolume": "Vol. X", "gazetteNumber": "No. 1", "gazetteDate": "2025-01-02"}')

    def triage(self, text):
        return F.lit("Tenders")

    def extract(self, text, category):
        return F.nullif(F.regexp_extract(text, "(?s)EXTRACT(.*?)(NARRATE|$)", 1), F.lit(""))

    def narrate(self, items, category):
        return F.get_json_object(items, "$.told")


def test_assembly(spark):
    told = json.dumps({"title": "T", "xSummary": "s", "significance": 9})
    docs = [
        "GAZETTE NOTICE NO. 4\nEXTRACT" + json.dumps({"items": {"notice_id": "77", "effective_date": "2025-03-04", "told": told}}),
        "GAZETTE NOTICE NO. 5\nEXTRACT" + json.dumps({"items": {"reference_number": "R"}}),
        "GAZETTE NOTICE NO. 6\nEXTRACT" + json.dumps({"items": []}),
        "GAZETTE NOTICE NO. 7\n",
        "GAZETTE NOTICE NO. 8\nEXTRACT" + json.dumps({"items": {"told": json.dumps({"xSummary": "x" * 281})}}),
    ]
    df = spark.createDataFrame([("\n".join(docs), "/p.pdf"), (None, "/q.pdf")], "text string, original_pdf_path string")
    rows = {r["source_order"]: r for r in ingest.ingest(df, DAY, NOW, Scripted()).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    ok, gen, lst, none, over = (rows[k] for k in range(1, 6))
    assert (ok["status"], ok["title"], ok["summary"], ok["notice_number"], ok["published_date"], ok["significance_rating"], ok["gazette_volume"]) == ("SUCCESS", "T", "No summary provided.", "77", dt.date(2025, 3, 4), 9, "Vol. X")
    assert (gen["status"], gen["notice_number"], gen["published_date"], gen["significance_rating"]) == ("FAILED", "R", dt.date(2025, 1, 2), 3)
    assert gen["title"] == "[GENERATION FAILED] Tenders Notice (Review Extracted Data)"
    assert (lst["summary"], lst["category"], lst["published_date"]) == ("The AI failed during processing. Reason: Extraction failed: AI returned null or empty 'items'", "Uncategorized", dt.date(2025, 5, 5))
    assert none["summary"].endswith("no 'items' wrapper")
    assert (over["status"], over["summary"]) == ("FAILED", "The AI failed during processing. Reason: Unhandled pipeline error")
    table = conform(ingest.ingest(df, DAY, NOW, Scripted()))
    assert [f.name for f in table.schema] == [f.name for f in S.NOTICES]


def test_number_from_text(spark):
    df = spark.createDataFrame([("Gazette Notice No. 9 says so", "/p.pdf")], "text string, original_pdf_path string")
    assert ingest.ingest(df, DAY, NOW, StubModel()).first()["notice_number"] == "9"


def test_client_model(spark):
    def ask(step, inputs):
        return {"header": ["{}"], "triage": ["Licensing"], "extract": ['{"items": {"notice_id": "1"}}'], "narrate": ['{"title": "told"}']}[step] * len(inputs)

    df = spark.createDataFrame([("body", "/p.pdf")], "text string, original_pdf_path string")
    r = ingest.ingest(df, DAY, NOW, CallModel(ask)).first()
    assert (r["title"], r["category"], r["notice_number"]) == ("told", "Licensing", "1")


def test_retry_asks_only_for_what_is_missing(spark, tmp_path):
    """Rows with extracted data cost a narrative call and no other; rows with neither cost all three; a reason costs no narrative."""
    log = tmp_path / "calls"

    def ask(step, inputs):
        with open(log, "a") as f:
            f.write("".join(f"{step}\n" for _ in inputs))
        return {"triage": ["Licensing"], "extract": ["{}"], "narrate": ['{"title": "told"}']}[step] * len(inputs)

    n = notices(spark, [{"id": i, "status": "FAILED", "title": S.PROCESSING_FAILED_TITLE, "category": "Tenders", "content": "x"} for i in range(11)])
    n = n.withColumn("extracted", F.when(F.col("id") < 9, F.lit('{"notice_id": "5"}')))
    got = ingest.retry(n, DAY, NOW, CallModel(ask)).collect()
    calls = log.read_text().split()
    assert {k: calls.count(k) for k in ("triage", "extract", "narrate")} == {"triage": 2, "extract": 2, "narrate": 9}
    assert sorted((r["id"], r["status"]) for r in got) == [(i, "SUCCESS" if i < 9 else "FAILED") for i in range(11)]


def test_filters_do_not_repeat_answers(spark):
    """A filter on what was assembled reads the answers; it doesn't take the model's expressions along, copy by copy."""
    cue = "sealed tender"
    n = sample_notices(spark, SF).withColumn("extracted", F.when(F.col("id") % 2 == 0, F.col("article")))
    docs = spark.createDataFrame([("body", "/p.pdf")], "text string, original_pdf_path string")
    for df in (ingest.retry(n, DAY, NOW), queries.succeeded(ingest.ingest(docs, DAY, NOW))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(cue) == 1
        assert len(plan) < 100_000


def test_call_policy():
    pauses, calls = [], []

    def failing(step, inputs):
        calls.append(step)
        if step == "denied":
            raise PermissionError
        if len(calls) < 3:
            raise OSError
        return ["a"] * len(inputs)

    ask = patient(failing, sleep=pauses.append)
    assert ask("extract", [("x",), ("y",)]) == ["a", "a"]
    assert pauses == [0.5, 2.0, 4.0]
    assert ask("denied", [("x",)]) == [None]
    assert len(calls) == 4

    def never(step, inputs):
        raise OSError

    assert patient(never, sleep=pauses.append)("extract", [("x",)]) == [None]


def test_store(spark, tmp_path):
    """Edits, votes, retries and deletes survive a re-read, before and after the changes are folded."""
    at = str(tmp_path / "table")
    assert store.current(spark, at).count() == 0
    store.append(notices(spark, [{"id": 0, "title": "a", "content": "1", "source_order": 1}, {"id": 0, "title": "b", "content": "2", "source_order": 2, "status": "FAILED"}]), at)
    n = store.current(spark, at)
    assert sorted((r["id"], r["title"]) for r in n.collect()) == [(1, "a"), (2, "b")]
    store.merge(mutations.edit(n, spark.createDataFrame([(1, "z")], "id long, title string")), at)
    events = spark.createDataFrame([(1, "view")] * 3, "user_id long, event_type string")
    store.merge(mutations.apply_events(store.current(spark, at), events), at)
    n = store.current(spark, at)
    store.merge(mutations.retry_merge(n, n.where("id = 2").withColumns({"title": F.lit("again"), "status": F.lit("SUCCESS")})), at)
    store.append(notices(spark, [{"id": 0, "title": "c", "content": "3"}]), at)
    want = [(1, "z", "SUCCESS", 3), (2, "again", "SUCCESS", 0), (3, "c", "SUCCESS", 0)]
    for _ in range(2):
        assert sorted((r["id"], r["title"], r["status"], r["view_count"]) for r in store.current(spark, at).collect()) == want
        store.compact(spark, at)
    store.remove(spark.createDataFrame([(2,), (99,)], "id long"), at)
    assert sorted(r["id"] for r in store.current(spark, at).collect()) == [1, 3]
    store.compact(spark, at)
    assert sorted(r["id"] for r in store.current(spark, at).collect()) == [1, 3]
    store._commit(store.current(spark, at).withColumn("deleted", F.lit(False)), at, 100)
    with pytest.raises(RuntimeError, match="another"):
        store._commit(store.current(spark, at).withColumn("deleted", F.lit(False)), at, 100)


PAGE = """<table><tr><th>x</th></tr>
<tr><td class="cell-title big"><a href="/akn/ke/officialGazette/2025/225">Kenya Gazette Vol. CXXVII No. 225</a></td><td>n</td><td>7 November 2025</td></tr>
<tr><td class="cell-title"><a href="/akn/ke/officialGazette/2025/224">Kenya Gazette Vol. CXXVII No. 224</a></td><td>31 October 2025</td></tr></table>
<a href="file.pdf">please <b>download PDF</b> here</a>"""


def test_listing(spark):
    pages = spark.createDataFrame([(1, PAGE, "https://law.example.org/g/2025"), (2, None, None), (3, "<a href='x'>", None)], "page_id long, html string, url string")
    assert [tuple(r) for r in listings.latest_listing(pages).collect()] == [(1, "https://law.example.org/akn/ke/officialGazette/2025/225", "Vol. CXXVII No. 225", dt.date(2025, 11, 7))]
    assert [tuple(r) for r in listings.download_link(pages).collect()] == [(1, "https://law.example.org/g/file.pdf")]
    stored = notices(spark, [{"id": 1, "gazette_number": "No. 225 of CXXVII", "gazette_date": dt.date(2025, 11, 7)}])
    assert api.run_scraper(pages, stored).count() == 0
    assert [r["file_name"] for r in api.run_scraper(pages, notices(spark, [])).collect()] == ["Kenya_Gazette_Vol__CXXVII_No__225_Dated_2025-11-07.pdf"]


def test_links_are_read_in_little_memory(spark):
    """Links of a row share its text, and a batch's links leave in parts; none is lost."""
    n, cell = 2000, "word " * 4000
    html = "<table><tr>" + "<td class='cell-title'><a href='/x'>x</a></td>" * n + f"<td>{cell}</td></tr></table>"
    tracemalloc.start()
    found = list(listings.links_of(html))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["row_text"] for x in found] == [cell.strip()] * n
    assert peak < 10_000_000  # 2,000 copies of the row's text are 40 MB
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9], "html": [html, None, "<a href='y'>z</a>"], "base": ["https://e.org/", None, None]})
    parts = list(listings._page_links(iter([batch])))
    assert max(p.nbytes for p in parts) < 2_000_000
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["id"], r["pos"], r["url"]) for r in rows] == [(7, i, "https://e.org/x") for i in range(n)] + [(9, 0, "y")]
    pages = spark.createDataFrame([("k", html, "https://e.org/")], "url string, html string, base string")
    assert listings.all_links(pages, "url", "html", "base").toDF("k", *"phutir").agg(F.count("*"), F.sum(F.length("r"))).first() == (n, n * len(cell.strip()))


def test_report_and_files(spark, tmp_path):
    n = notices(spark, [{"id": 1, "content": "a\n\"b\",c", "gazette_date": dt.date(2024, 1, 2)}, {"id": 2}])
    assert export.report(n).columns == list(export.HEADERS)
    export.write_report(export.report_all(n), str(tmp_path / "r"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "r"))
    assert {r["ID"]: r["Original Content"] for r in back.collect()}["1"] == 'a\n"b",c'
    n.write.parquet(str(tmp_path / "t"))
    assert read_notices(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"GAZETTE NOTICE NO. 1\nA\nGAZETTE NOTICE NO. 2\nB")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    rows = api.add(spark, str(tmp_path / "in"), DAY, NOW).collect()
    assert sorted(r["notice_number"] for r in rows) == ["1", "2"]
    with pytest.raises(ValueError, match="empty"):
        files.upload("/in", "x.pdf", b"")
    for data in (b"GAZETTE NOTICE NO. 7\nC", b"GAZETTE NOTICE NO. 8\n\x00\xff"):
        assert files.upload(str(tmp_path / "up"), "../x/c.pdf", data, spark) == str(tmp_path / "up" / "c.pdf")
        assert (tmp_path / "up" / "c.pdf").read_bytes() == data
    assert [r["notice_number"] for r in api.add(spark, str(tmp_path / "up"), DAY, NOW).collect()] == ["8"]


def sheets(path):
    """Rows of each sheet of a workbook, read by the rules of the format."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = {}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        kinds = {o.get("PartName") for o in ElementTree.fromstring(z.read("[Content_Types].xml"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns):
            part = f"xl/{parts[sheet.get(rel)]}"
            assert f"/{part}" in kinds
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iterfind(".//m:row", ns):
                cells = []
                for c in row.iterfind("m:c", ns):
                    text, number = c.find("m:is/m:t", ns), c.find("m:v", ns)
                    kept = re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m.group(1), 16)), text.text or "") if text is not None else None
                    cells.append(kept if text is not None else number if number is None else int(number.text))
                    assert len(rows) or c.get("s") == "1"
                rows.append(tuple(cells))
            out[sheet.get("name")] = rows
    return out


def test_workbook(spark, tmp_path, monkeypatch):
    odd = "<a> & \"b\"\n\tc\r\x0b _x0041_ \U0001f600 \uffff "
    n = notices(spark, [{"id": 1, "title": odd, "gazette_date": dt.date(2024, 1, 2)}, {"id": 2, "content": "w " * 20000}, {"id": 3, "title": "\U0001f600" * 20000}])
    rows = export.report(n.orderBy("id"))
    export.write_report(rows, str(tmp_path / "x" / "Export_a.xlsx"), "xlsx")
    want = [tuple(r) for r in rows.collect()]
    got = sheets(tmp_path / "x" / "Export_a.xlsx")
    assert list(got) == ["Gazettes"]
    assert got["Gazettes"][0] == export.HEADERS
    assert got["Gazettes"][1:3] == want[:2]
    assert got["Gazettes"][3][1] == "\U0001f600" * 16383  # what a cell can hold
    export.write_report(rows.limit(0), str(tmp_path / "x" / "Export_a.xlsx"), "xlsx")
    assert sheets(tmp_path / "x" / "Export_a.xlsx") == {"Gazettes": [export.HEADERS]}
    monkeypatch.setattr(workbook, "MAX_ROWS", 3)
    export.write_report(rows, str(tmp_path / "b.xlsx"), "xlsx")
    assert [len(r) for r in sheets(tmp_path / "b.xlsx").values()] == [3, 2]
    assert list(sheets(tmp_path / "b.xlsx")) == ["Gazettes", "Gazettes 2"]


def test_no_half_file(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), new_file(spark, str(tmp_path / "a")) as out:
        out.write(b"x")
        raise ZeroDivisionError
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == []


def test_filters_reach_the_scan(spark, tmp_path):
    sample_notices(spark, SF).write.parquet(str(tmp_path / "n"))
    df = queries.public_list(read_notices(spark, str(tmp_path / "n")), "significant").select("id", "significance_rating")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(status,SUCCESS)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "content" not in plan[plan.index("ReadSchema") :]


def test_dashboard(spark):
    got = api.dashboard(sample_notices(spark, SF))
    assert got["totals"].count() == 1
    assert got["top"].count() <= 3
    assert api.categories(spark).count() == 9
