"""Tables written for people: delimited text that a spreadsheet cannot run, and small workbooks, one to a group of rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BAD = {i: None for i in (*range(9), 11, 12, *range(14, 32))}
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def guarded(c: Column) -> Column:
    """A text that a spreadsheet takes for text: what begins like a formula gets an apostrophe in front."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_line(columns: Sequence[Column]) -> Column:
    """One line of delimited text: every field guarded, those with a comma, quote or line end in quotes."""
    quoted = lambda t: F.when(t.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    return F.concat_ws(",", *(quoted(guarded(c)) for c in columns))


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        n, out = n // 26 - 1, chr(65 + n % 26) + out
    return out


def workbook(rows: Iterable[Sequence[str | None]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet of texts; empty cells are left out."""
    lines = []
    for r, row in enumerate(rows, 1):
        cells = (f'<c r="{_letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v).translate(_BAD))}</t></is></c>' for k, v in enumerate(row) if v is not None)
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    return archive(parts)


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(path, content) with one workbook, headed by ``columns``, for each value of ``key``: a group is one file, so it
    must be as small as a workbook is."""

    def write(group):
        import pandas as pd

        table = group[list(columns)].astype(object).where(group[list(columns)].notna(), None)
        return pd.DataFrame({"path": [f"{group[key].iloc[0]}.xlsx"], "content": [workbook([list(columns), *table.values.tolist()])]})

    return rows.select(key, *columns).groupBy(key).applyInPandas(write, "path string, content binary")
