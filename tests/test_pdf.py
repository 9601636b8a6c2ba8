import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone import api
from lodestone.sources import files, pdf

DAY, NOW = "2025-05-05", "2025-05-05 06:07:08"


def stream(data, extra="", pack=False):
    data = zlib.compress(data) if pack else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode ' if pack else ''}{extra}>>\nstream\n".encode() + data + b"\nendstream"


def build(objects, trailer="/Root 1 0 R"):
    """A file of numbered objects."""
    body = b"".join(f"{k} 0 obj\n".encode() + v + b"\nendobj\n" for k, v in objects.items())
    return b"%PDF-1.4\n%\xe2\xe3\n" + body + f"trailer\n<< {trailer} >>\n%%EOF".encode()


def simple(contents, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=None, pack=False):
    """A file with a page for each content stream."""
    n = len(contents)
    pages = " ".join(f"{10 + 2 * k} 0 R" for k in range(n))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{pages}] /Count {n} /Resources << /Font << /F1 3 0 R >> >> >>".encode(), 3: font, **(more or {})}
    for k, c in enumerate(contents):
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = stream(c, pack=pack)
    return build(objects)


def escaped(s):
    return s.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


@pytest.mark.parametrize("pack", [False, True])
def test_pages_lines_and_gaps(pack):
    first = b"BT /F1 12 Tf 72 700 Td (A \\(first\\) line \\101) Tj 0 -14 Td [(Wo) 20 (rd) -300 (gap)] TJ T* (third) Tj (fourth) ' ET"
    second = b"q BI /W 1 /H 1 ID \x00(\xff) Tj EI Q BT 1 0 0 1 72 700 Tm <48 69> Tj 1 0 0 1 90 700 Tm (there) Tj ET % (no) Tj"
    assert pdf.pages_text(simple([first, second, b""], pack=pack)) == ["A (first) line A\nWord gap\nthird\nfourth", "Hi there", ""]


def test_character_maps():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <d83dde00>] endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
    assert pdf.pages_text(simple([b"BT /F1 9 Tf <0003001000120020002100ff> Tj ET"], font, {4: stream(cmap, pack=True)})) == ["Aacfi\U0001f600"]
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [2 /fi /uni20AC /one 65 /B /odd.name] >> >>"
    assert pdf.pages_text(simple([b"BT /F1 9 Tf <0203044142> Tj ET"], named)) == ["fi\u20ac1BB"]


def test_packed_objects_and_later_versions():
    held = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [5 0 R] >>", b"<< /Type /Page /Contents [6 0 R 7 0 R] >>"]
    places, at = [], 0
    for number, v in zip((1, 2, 5), held, strict=True):
        places.append(f"{number} {at}")
        at += len(v) + 1
    head = (" ".join(places) + " ").encode()
    packed = stream(head + b" ".join(held), f"/Type /ObjStm /N 3 /First {len(head)} ", pack=True)
    data = build({9: packed, 6: stream(b"BT (old) Tj ET"), 7: stream(b"BT (second) Tj ET")}) + b"\n6 0 obj\n" + stream(b"BT (new) Tj ET") + b"\nendobj\n"
    assert pdf.pages_text(data) == ["new\nsecond"]


def test_damage():
    data = simple([b"BT (text) Tj ET"])
    assert pdf.pages_text(data.replace(b"/Length 15", b"/Length 99")) == ["text"]
    assert pdf.pages_text(data[: data.index(b"trailer")]) == ["text"]
    assert pdf.pages_text(b"%PDF-1.4") == []
    loop = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 2 0 R] >>"})
    assert pdf.pages_text(loop) == []
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pages_text(build({1: b"<< /Type /Catalog >>"}, "/Root 1 0 R /Encrypt 8 0 R"))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.text(alphabet="ab (\\)\r'<>/%\xe9\u20ac1", min_size=1, max_size=12).filter(lambda s: s.strip()), max_size=4), max_size=4))
def test_round_trip(pages):
    contents = [b"BT /F1 10 Tf " + b" T* ".join(b"(" + escaped(s) + b") Tj" for s in lines) + b" ET" for lines in pages]
    assert pdf.pages_text(simple(contents, pack=True)) == ["\n".join(lines) for lines in pages]


def test_files(spark, tmp_path):
    notice = [b"BT (GAZETTE NOTICE NO. 1) Tj T* (A) Tj ET", b"BT (GAZETTE NOTICE NO. 2) Tj T* (B) Tj ET"]
    (tmp_path / "a.pdf").write_bytes(simple(notice, pack=True))
    (tmp_path / "b.pdf").write_bytes(b"GAZETTE NOTICE NO. 3\nplain")
    (tmp_path / "c.pdf").write_bytes(build({1: b"<< >>"}, "/Encrypt 2 0 R"))
    texts = {r["original_pdf_path"][-5:]: r["text"] for r in files.extract_text(files.read_files(spark, str(tmp_path))).collect()}
    assert texts == {"a.pdf": "GAZETTE NOTICE NO. 1\nA\nGAZETTE NOTICE NO. 2\nB", "b.pdf": "GAZETTE NOTICE NO. 3\nplain", "c.pdf": None}
    assert sorted(r["notice_number"] for r in api.add(spark, str(tmp_path), DAY, NOW).collect() if r["notice_number"]) == ["1", "2", "3"]
