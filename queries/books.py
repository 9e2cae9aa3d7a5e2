"""Small workbooks, for queries and tests that read them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(rows: pd.DataFrame, kinds: dict[str, str]) -> bytes:
    """One sheet with a header and the named columns, as numbers, shared strings or inline strings."""
    shared: list[str] = []

    def cell(kind: str, value: str) -> str:
        if kind == "number":
            return f"<c><v>{value}</v></c>"
        if kind == "inline":
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        shared.append(value)
        return f'<c t="s"><v>{len(shared) - 1}</v></c>'

    lines = ["".join(cell("inline", name) for name in kinds)]
    lines += ["".join(cell(k, str(v)) for k, v in zip(kinds.values(), row, strict=True)) for row in rows[list(kinds)].itertuples(index=False)]
    sheet = "".join(f"<row>{line}</row>" for line in lines)
    strings = "".join(f"<si><t>{escape(s)}</t><rPh sb='0' eb='1'><t>x</t></rPh></si>" for s in shared)
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{strings}</sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(zipfile.ZipInfo(name), text)
    return held.getvalue()
