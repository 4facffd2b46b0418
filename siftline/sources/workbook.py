"""One workbook file of many sheets, written row by row: no sheet is held in memory.

Defined results: the first row of a sheet has its column names, bold and frozen;
whole numbers are numbers and all else is text, never a formula.  A sheet of more
rows than the format allows goes on in ``name (2)`` and so on.  Fixed by the
format: characters that XML has no place for are left out, and a cell's text is
cut at 32,767 characters, as spreadsheet programs do.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.sax.saxutils import escape

#: Limits of the format (fixed values).
MOST_ROWS, MOST_CHARACTERS, MOST_IN_NAME = 1_048_576, 32_767, 31
_NOT_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)


def _cell(value: object, style: int = 0) -> str:
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 10**15:  # larger ones would lose digits
        return f"<c><v>{value}</v></c>"
    text = escape(_NOT_XML.sub("", str(value))[:MOST_CHARACTERS]).replace("\r", "&#13;")
    return f'<c t="inlineStr"{f" s={chr(34)}{style}{chr(34)}" if style else ""}><is><t xml:space="preserve">{text}</t></is></c>'


def _row(values: Iterable[object], style: int = 0) -> bytes:
    return f"<row>{''.join(_cell(v, style) for v in values)}</row>".encode()


def write(sheets: Iterable[tuple[str, list[str], Iterator[Iterable[object]]]], out: BinaryIO, most_rows: int = MOST_ROWS) -> list[str]:
    """Write ``(name, columns, rows)`` in order; returns the names of the sheets in the file."""
    names: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name, columns, rows in sheets:
            rows, part = iter(rows), 1
            row = next(rows, None)
            while row is not None or part == 1:
                tail = "" if part == 1 else f" ({part})"
                names.append(name[: MOST_IN_NAME - len(tail)] + tail)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                    f.write(_row(columns, 1))
                    n = 1
                    while row is not None and n < most_rows:
                        f.write(_row(row))
                        n, row = n + 1, next(rows, None)
                    f.write(b"</sheetData></worksheet>")
                part += 1
        at = range(1, len(names) + 1)
        listed = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, x in zip(at, names))
        linked = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in at)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}worksheet+xml"/>' for i in at)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{linked}<Relationship Id="styles" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}styles+xml"/>{kinds}</Types>')
    return names
