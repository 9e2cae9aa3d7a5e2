"""Workbooks (.xlsx): the first sheet of each file, files being the unit of parallelism.

Spark lists and distributes the files; a small helper reads the zipped XML of one file row by row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.operators.settle import settle
from schemalign.sources.delimited import distinct_headers

# XML namespaces of the format, and its built-in number formats that show a date.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 22}
TIME_FORMATS = {18, 19, 20, 21, 45, 46, 47}

BATCH_ROWS = 2000


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = _part(book, "xl/workbook.xml").find(f"{MAIN}sheets")
    wanted = sheets[0].get(RELATION)
    for relation in _part(book, "xl/_rels/workbook.xml.rels"):
        if relation.get("Id") == wanted:
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without a sheet")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    table = _part(book, "xl/sharedStrings.xml")
    if table is None:
        return []
    return [_plain(entry) for entry in table.findall(f"{MAIN}si")]


def _plain(entry: ElementTree.Element) -> str:
    """The text of a string and its formatted runs, without the readings given for its pronunciation."""
    runs = [entry, *entry.findall(f"{MAIN}r")]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{MAIN}t"))


def _moment_styles(book: zipfile.ZipFile) -> dict[int, str]:
    """Cell styles that show a moment: 'date', or 'time' for a time of day."""
    styles = _part(book, "xl/styles.xml")
    if styles is None:
        return {}
    shown = dict.fromkeys(DATE_FORMATS, "date") | dict.fromkeys(TIME_FORMATS, "time")
    for fmt in styles.iter(f"{MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\[[^\]hms]*\]|\\.', "", fmt.get("formatCode", ""), flags=re.IGNORECASE)
        if re.search("[dy]", bare, re.IGNORECASE):
            shown[int(fmt.get("numFmtId"))] = "date"
        elif re.search("[hs]", bare, re.IGNORECASE):
            shown[int(fmt.get("numFmtId"))] = "time"
    formats = styles.find(f"{MAIN}cellXfs")
    numbers = [int(xf.get("numFmtId", 0)) for xf in (formats if formats is not None else [])]
    return {i: shown[n] for i, n in enumerate(numbers) if n in shown}


def _first_day(book: zipfile.ZipFile) -> datetime:
    """Day 0 of the workbook's calendar, which may start in 1904."""
    settings = _part(book, "xl/workbook.xml").find(f"{MAIN}workbookPr")
    later = settings is not None and settings.get("date1904", "0").lower() in ("1", "true")
    return datetime(1904, 1, 1) if later else datetime(1899, 12, 30)


def _as_moment(serial: str, kind: str, first_day: datetime) -> str:
    seconds = round(float(serial) * 86_400)
    moment = first_day + timedelta(seconds=seconds)
    if kind == "time" and 0 <= seconds < 86_400:
        return str(moment.time())
    return str(moment.date()) if kind == "date" and not seconds % 86_400 else str(moment)


def _position(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as texts, blank cells None; rows without any value are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, shown, first_day = _shared_strings(book), _moment_styles(book), _first_day(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                values: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    at = _position(cell.get("r")) if cell.get("r") else len(values)
                    values.extend([None] * (at + 1 - len(values)))
                    values[at] = _text(cell, strings, shown, first_day)
                row.clear()
                if any(v is not None for v in values):
                    yield values


def _text(
    cell: ElementTree.Element, strings: list[str], shown: dict[int, str], first_day: datetime
) -> str | None:
    kind, raw = cell.get("t"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(_plain(entry) for entry in cell.findall(f"{MAIN}is"))
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    style = int(cell.get("s", 0))
    if kind in (None, "n") and style in shown:
        return _as_moment(raw, shown[style], first_day)
    return raw


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows: list[tuple[str, int, list[str | None]]] = []
            for nth, values in enumerate(sheet_rows(content)):
                rows.append((path, nth, distinct_headers([v or "" for v in values]) if nth == 0 else values))
                if len(rows) == BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=["source_id", "nth", "values"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["source_id", "nth", "values"])


def read_workbook(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """files (source_id, delimiter, columns) and rows (source_id, values) of the first sheets, as for text files.

    Of a folder, the files named *.xlsx.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
    return sheets_of(found.load([paths] if isinstance(paths, str) else list(paths)))


def sheets_of(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and rows of workbooks given as (path, content). Each is parsed once: what it holds is settled."""
    sheets = settle(books.select("path", "content").mapInPandas(_read, "source_id string, nth int, values array<string>"))
    files = sheets.filter(F.col("nth") == 0).select(
        "source_id", F.lit(None).cast("string").alias("delimiter"), F.col("values").alias("columns")
    )
    return files, sheets.filter(F.col("nth") > 0).select("source_id", "values")
