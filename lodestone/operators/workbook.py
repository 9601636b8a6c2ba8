"""A report as a spreadsheet workbook: a zip of XML parts, written row by row."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import BinaryIO
from xml.sax.saxutils import escape

# The sheet's name, and the format's limits on rows of a sheet and UTF-16 units of a cell.
SHEET = "Gazettes"
MAX_ROWS = 1_048_576
MAX_UNITS = 32_767
#: XML of a sheet before the next one begins; a part of the zip must stay under 2 GiB.
MAX_BYTES = 1 << 30

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Cell format 0 is plain, 1 is bold.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)
#: What XML can't hold or would change, and text that reads like the way such characters are written.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(value: str) -> str:
    if len(value) > MAX_UNITS // 2 and len(units := value.encode("utf-16-le")) > 2 * MAX_UNITS:
        value = units[: 2 * MAX_UNITS].decode("utf-16-le", "ignore")
    return escape(_ODD.sub(lambda m: f"_x{ord(m.group()):04X}_", value))


def _row(values: Sequence, bold: bool = False) -> str:
    style = ' s="1"' if bold else ""
    cells = []
    for v in values:
        if v is None:
            cells.append("<c/>")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f"<c{style}><v>{v}</v></c>")
        else:
            cells.append(f'<c{style} t="inlineStr"><is><t xml:space="preserve">{_text(str(v))}</t></is></c>')
    return f"<row>{''.join(cells)}</row>"


def write(out: BinaryIO, headers: Sequence[str], rows: Iterable[Sequence]) -> int:
    """Write a workbook to a stream that need not seek, and return the number of its sheets.

    Each sheet begins with the headers in bold; what goes beyond a sheet's limits goes on in the next. Numbers stay numbers, a
    null is an empty cell, a text beyond a cell's limit is cut there. No more than one row is held.
    """
    left: Iterator[Sequence] = iter(rows)
    row = next(left, None)
    names: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        while row is not None or not names:
            names.append(SHEET if not names else f"{SHEET} {len(names) + 1}")
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as part:
                size = part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row(headers, bold=True)}'.encode())
                n = 1
                while row is not None and n < MAX_ROWS and size < MAX_BYTES:
                    size += part.write(_row(row).encode())
                    n += 1
                    row = next(left, None)
                part.write(b"</sheetData></worksheet>")
        each = range(1, len(names) + 1)
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{names[k - 1]}" sheetId="{k}" r:id="r{k}"/>' for k in each) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each) + f'<Relationship Id="r0" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_KIND}.worksheet+xml"/>' for k in each)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/>{parts}</Types>')
    return len(names)
