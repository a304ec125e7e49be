"""Uploaded files: reading them, their text, and their previews.

Word and spreadsheet files are read with the standard library. Text of PDF files and of images needs
libraries that are not part of this package, so readers for them are passed in; without one a file's
row carries an error instead of a text. Decoding runs in Arrow-batched Python, everything else in SQL.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.functions.text import UPLOADS, suffix

# Which files are images, and how much of a spreadsheet is previewed.
IMAGES = (".jpg", ".jpeg", ".png", ".webp")
PREVIEW_ROWS, PREVIEW_COLUMNS = 100, 20
PDF_RENDER_SCALE = 2

# Numbered formats of dates and times, as the file format defines them.
_DATE_FORMATS = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Bytes to pages of text; bytes to images of pages; bytes or image to text.
PdfText = Callable[[bytes], list[str]]
PdfImages = Callable[[bytes, int], list]
Ocr = Callable[[object], str]


def supported(filename: Column) -> Column:
    return suffix(filename).isin(*UPLOADS)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def stored(documents: DataFrame, files: DataFrame, root: str, most_named: int = 10_000) -> DataFrame:
    """Documents with content and found; the key is compared with the path below root, no path is built to be opened.

    The paths are matched first, without reading any content. If at most most_named match, only these files are
    read; more are read by a scan of all files, joined with the matched paths.
    """
    base = root.rstrip("/") + "/"
    key = F.element_at(F.split(F.col("path"), re.escape(base), 2), -1)
    wanted = documents.select(F.col("object_key").alias("__key")).where("__key IS NOT NULL").distinct()
    matched = files.select("path").join(wanted, key == F.col("__key"), "left_semi")
    names = [r[0] for r in matched.limit(most_named + 1).collect()]
    if not names:
        some = files.select("path", "content").limit(0)
    elif len(names) <= most_named:
        some = files.sparkSession.read.format("binaryFile").load(names).select("path", "content")
    else:
        some = files.select("path", "content").join(matched, "path", "left_semi")
    some = some.select(key.alias("__key"), "content")
    return documents.join(some, F.col("object_key") == F.col("__key"), "left").withColumn("found", F.col("__key").isNotNull()).drop("__key")


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the body's own paragraphs, not of those in tables and text boxes."""
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}ptab": lambda e: "\t", f"{_W}cr": lambda e: "\n", f"{_W}noBreakHyphen": lambda e: "-", f"{_W}br": lambda e: "\n" if e.get(f"{_W}type", "textWrapping") == "textWrapping" else ""}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        runs = [r for child in p for r in ([child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else ())]
        out.append("".join(parts[e.tag](e) for r in runs for e in r if e.tag in parts))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> list[str | None]:
    """Of each cell style whether its numbers are dates or times ("date"), time spans ("span"), or neither."""
    if "xl/styles.xml" not in z.namelist():
        return []
    tree = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in tree.iter(f"{_S}numFmt")}
    out: list[str | None] = []
    for xf in tree.findall(f"{_S}cellXfs/{_S}xf"):
        n = int(xf.get("numFmtId", 0))
        code = own.get(n, _DATE_FORMATS.get(n, ""))
        span = re.search(r"\[(h+|m+|s+)\]", code, re.I)
        plain = re.sub(r"\"[^\"]*\"|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]", "", code)
        out.append("span" if span else "date" if re.search(r"(?<![_\\])[dmhys]", plain, re.I) else None)
    return out


def _moment(number: float, kind: str, first: datetime):
    """The date, time or time span that a serial number stands for."""
    if kind == "span":
        return timedelta(days=number)
    days, part = divmod(number, 1)
    within = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= number < 1 and within.days == 0:
        return (datetime.min + within).time()
    if 0 < number < 60 and first.year == 1899:  # that calendar has a day 29 February 1900
        days += 1
    return first + timedelta(days=days) + within


def xlsx_sheets(content: bytes) -> tuple[list[tuple[str, list[list]]], int]:
    """Title and rows of cell values (None where empty) of every sheet, and which sheet is the active one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        styles = _date_styles(z)
        settings = book.find(f"{_S}workbookPr")
        first = datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        view = book.find(f"{_S}bookViews/{_S}workbookView")
        active = int(view.get("activeTab", 0)) if view is not None else 0
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for s in book.find(f"{_S}sheets"):
            target = targets[s.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for r in tree.iter(f"{_S}row"):
                while len(rows) < int(r.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                row: list = []
                for c in r.findall(f"{_S}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(row)
                    row += [None] * (at - len(row))
                    value = _value(c, shared)
                    style = int(c.get("s", 0))
                    if style < len(styles) and styles[style] and isinstance(value, (int, float)) and not isinstance(value, bool):
                        value = _moment(value, styles[style], first)
                    row.append(value)
                rows.append(row)
            sheets.append((s.get("name"), rows))
    return sheets, active


def _value(cell, shared: list[str]):
    kind, v = cell.get("t"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() and "." not in v.text and "e" not in v.text.lower() else number


def xlsx_text(content: bytes) -> str:
    sheets, _ = xlsx_sheets(content)
    return "\n".join(" | ".join(str(x) for x in row if x is not None) for _, rows in sheets for row in rows)


def xlsx_grid(content: bytes) -> tuple[str | None, list[list[str]]]:
    """The active sheet's title, and its first rows and columns as text."""
    sheets, active = xlsx_sheets(content)
    title, rows = sheets[active] if active < len(sheets) else (None, [])
    width = min(PREVIEW_COLUMNS, max((len(r) for r in rows), default=0))
    return title, [["" if x is None else str(x) for x in (r + [None] * width)[:width]] for r in rows[:PREVIEW_ROWS]]


class Readers:
    """Readers by suffix. Pass callables for PDF files and images; they are sent to the executors and should load models lazily."""

    def __init__(self, pdf_text: PdfText | None = None, pdf_images: PdfImages | None = None, ocr: Ocr | None = None, prepare: Callable[[bytes], object] | None = None):
        self.pdf_text, self.pdf_images, self.ocr, self.prepare = pdf_text, pdf_images, ocr, prepare

    def read(self, kind: str, content: bytes) -> str:
        if kind == ".docx":
            return "\n".join(docx_paragraphs(content))
        if kind == ".xlsx":
            return xlsx_text(content)
        if kind in IMAGES:
            if self.ocr is None:
                raise ValueError("no reader for images was given")
            return self.ocr(self.prepare(content) if self.prepare else content)
        if kind == ".pdf":
            if self.pdf_text is None:
                raise ValueError("no reader for PDF files was given")
            text = "\n".join(self.pdf_text(content))
            if not text.strip():  # a scan: its pages are read as images
                if self.pdf_images is None or self.ocr is None:
                    raise ValueError("no reader for scanned PDF files was given")
                text = "\n".join(self.ocr(p) for p in self.pdf_images(content, PDF_RENDER_SCALE))
            return text
        raise ValueError(f"unsupported file type {kind or 'without suffix'}")


_TEXTS = "id string, text string, error string"


def texts(documents: DataFrame, readers: Readers | None = None) -> DataFrame:
    """id, text, error of documents with filename, content and found. One bad file spoils only its own row."""
    reader = readers or Readers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kind, content, found in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if not found or content is None:
                        raise FileNotFoundError("file not found")
                    rows.append((key, reader.read(kind, content), None))
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [(), (), ()])], names=["id", "text", "error"])

    return documents.select("id", suffix(F.col("filename")).alias("kind"), "content", "found").mapInArrow(run, _TEXTS)


_PREVIEW = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("sheet", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("error", T.StringType())])


def previews(documents: DataFrame) -> DataFrame:
    """id, type (document, spreadsheet, binary), lines, or sheet and rows, and error, for documents with filename, content and found."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_PREVIEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kind, content, found in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if not found or content is None:
                        raise FileNotFoundError("file not found")
                    if kind == ".docx":
                        rows.append((key, "document", [p for p in docx_paragraphs(content) if p.strip()], None, None, None))
                    elif kind == ".xlsx":
                        rows.append((key, "spreadsheet", None, *xlsx_grid(content), None))
                    else:
                        rows.append((key, "binary", None, None, None, None))
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    rows.append((key, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return documents.select("id", suffix(F.col("filename")).alias("kind"), "content", "found").mapInArrow(run, _PREVIEW)
