"""Workbooks (.xlsx): the first sheet's rows, read on the executors.

A workbook is a zip of XML. Its bytes come from Spark, so any store will do; the sheet is parsed as a stream, and
what is held of it are its shared texts and the row at hand.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sheet that are handed on at once.
BATCH = 10_000
#: Numbers of the built-in formats that show dates or times.
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(file: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name, each forgotten once it was used."""
    with file.open(part) as f:
        for _, x in ElementTree.iterparse(f):
            if _name(x.tag) == name:
                yield x
                x.clear()


def _text(x: ElementTree.Element) -> str:
    """Runs of a text under one another, without phonetic hints."""
    return "".join(t.text or "" for child in x for t in ([child] if _name(child.tag) == "t" else child if _name(child.tag) == "r" else ()) if _name(t.tag) == "t")


def column_of(reference: str) -> int:
    """The number of a cell's column, from 0: A is 0, AA is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def date_of(serial: float, since_1904: bool = False) -> str:
    """A date as text, with its time. Numbers below 60 are before a day that the format counts and no calendar has."""
    days = serial + (0 if since_1904 else 1 if serial < 60 else 0)
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
    return str(start + timedelta(seconds=round(days * 86400)))


def _dated(file: zipfile.ZipFile) -> list[bool]:
    """For each style, whether it shows a date."""
    if "xl/styles.xml" not in file.namelist():
        return []
    with file.open("xl/styles.xml") as f:
        root = ElementTree.parse(f).getroot()
    own = {int(x.get("numFmtId")): bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")), re.I)) for x in root.iter() if _name(x.tag) == "numFmt"}
    styles = next((x for x in root if _name(x.tag) == "cellXfs"), ())
    return [own.get(n, n in DATES) for n in (int(x.get("numFmtId", 0)) for x in styles)]


def _first_sheet(file: zipfile.ZipFile) -> tuple[str, bool]:
    """The part of the first sheet, and whether dates count from 1904."""
    with file.open("xl/workbook.xml") as f:
        book = ElementTree.parse(f).getroot()
    sheet = next(x for x in book.iter() if _name(x.tag) == "sheet")
    key = next(v for k, v in sheet.attrib.items() if _name(k) == "id")
    target = next(x.get("Target") for x in _elements_kept(file, "xl/_rels/workbook.xml.rels") if x.get("Id") == key)
    since = any(x.get("date1904") in ("1", "true") for x in book.iter() if _name(x.tag) == "workbookPr")
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), since


def _elements_kept(file: zipfile.ZipFile, part: str) -> list[ElementTree.Element]:
    with file.open(part) as f:
        return list(ElementTree.parse(f).getroot())


def rows_of(content: bytes) -> Iterator[dict[int, str]]:
    """Each row of the first sheet as its cells' text by column; cells without a value are missing, empty rows too."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        shared = [_text(x) for x in _elements(file, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in file.namelist() else []
        dated = _dated(file)
        part, since_1904 = _first_sheet(file)
        for row in _elements(file, part, "row"):
            out, at = {}, -1
            for cell in row:
                at = column_of(cell.get("r")) if cell.get("r") else at + 1
                kind, style = cell.get("t", "n"), int(cell.get("s", 0))
                value = next((v.text for v in cell if _name(v.tag) == "v"), None)
                if kind == "inlineStr":
                    value = next((_text(v) for v in cell if _name(v.tag) == "is"), None)
                elif value is None or kind == "e":
                    continue
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "True" if value == "1" else "False"
                elif kind == "n":
                    number = float(value)
                    value = date_of(number, since_1904) if style < len(dated) and dated[style] else str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
                if value is not None and value != "":
                    out[at] = value
            if out:
                yield out


def sheet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The first sheet of each workbook under path, whose first row has names; columns by name, as ``files.csv`` gives them.

    Whole numbers are texts without a fraction, dates ISO texts, before they are cast to the schema's types; what can't be
    cast, errors, and columns that a sheet lacks are null. Of columns of one name the first counts. A file that is no workbook stops the job;
    among several, files without a byte are passed over.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], [f"c{i}" for i in range(len(names))])

        for b in batches:
            for content in b.column(0):
                held, places = [], None
                for row in rows_of(content.as_py()):
                    if places is None:
                        told = {v.strip(): k for k, v in reversed(row.items())}
                        places = [told.get(n) for n in names]
                        continue
                    held.append([row.get(p) for p in places])
                    if len(held) == BATCH:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    books = spark.read.format("binaryFile").load(path)
    if books.select("path").isEmpty():  # Spark passes over files without a byte
        raise ValueError(f"no workbook at {path}, or an empty file")
    texts = books.select("content").mapInArrow(run, ", ".join(f"c{i} string" for i in range(len(names))))
    return texts.select(*(F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(wanted.fields)))
