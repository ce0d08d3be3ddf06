"""Survey files: CSV and workbooks in, CSV out."""

from __future__ import annotations

import csv
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: Workbooks are read on the driver; larger ones have to come as CSV.
LARGEST_WORKBOOK = 50 * 1024 * 1024


def read_csv(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """A CSV with all columns as text; rows before the header row are left out.

    The header is read from the first lines of one file; the scan itself is distributed.
    """
    if header_row == 1:
        return spark.read.csv(path, header=True, inferSchema=False, escape='"')
    head = [r.value for r in spark.read.text(path).limit(header_row).collect()]
    names = next(csv.reader([head[-1]]))
    lines = spark.read.text(path).filter(~F.col("value").isin(head) & (F.trim("value") != ""))
    schema = ", ".join(f"`{n.strip()}` string" for n in names)
    return lines.select(F.from_csv("value", schema, {"escape": '"'}).alias("x")).select("x.*")


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    names = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS)
    return {s.get("name"): "xl/" + links[s.get(f"{{{_NS['r']}}}id")].removeprefix("/xl/") for s in names}


def _cells(book: zipfile.ZipFile, part: str):
    """(row number, {column letter: text}) of a sheet, one row at a time."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    for _, row in ElementTree.iterparse(book.open(part)):
        if not row.tag.endswith("}row"):
            continue
        out = {}
        for c in row.findall("m:c", _NS):
            value = c.find("m:v", _NS)
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
            if text is not None:
                out[re.match("[A-Z]+", c.get("r"))[0]] = text
        yield int(row.get("r")), out
        row.clear()


def _open(path: str) -> zipfile.ZipFile:
    if Path(path).stat().st_size > LARGEST_WORKBOOK:
        raise ValueError("workbooks of more than 50 MB have to be saved as CSV")
    return zipfile.ZipFile(path)


def inspect_workbook(path: str) -> list[dict]:
    """Name and number of rows of every sheet."""
    with _open(path) as book:
        return [{"name": n, "approximate_rows": max((r for r, _ in _cells(book, p)), default=0)} for n, p in _sheets(book).items()]


def read_sheet(spark: SparkSession, path: str, sheet: str, header_row: int = 1) -> DataFrame:
    """A sheet's rows below its header, all columns as text."""
    with _open(path) as book:
        rows = list(_cells(book, _sheets(book)[sheet]))
    header = {k: v.strip() for k, v in next((c for r, c in rows if r == header_row), {}).items()}
    data = [tuple(c.get(k) for k in header) for r, c in rows if r > header_row]
    return spark.createDataFrame(data, T.StructType([T.StructField(h, T.StringType()) for h in header.values()]))


def preview(table: DataFrame, limit: int = 20) -> tuple[list[str], list[dict], int]:
    """Header, the first rows, and the number of rows."""
    return table.columns, [r.asDict() for r in table.limit(limit).collect()], table.count()


def write_workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """A plain workbook with text and number cells."""
    letter = lambda i: chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)

    def cell(r: int, c: int, v: object) -> str:
        at = f'r="{letter(c)}{r}"'
        return f"<c {at}><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c {at} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1) if row)
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')


def sample_workbook(path: str, rows: int = 60) -> None:
    """A deterministic sample: header in row 4, ten columns, and a second sheet."""
    header = ["Survey ID", "NPS", "CSAT", "Professionalism", "Comment", "Agent BMS", "Agent Name", "Supervisor", "Survey Date", "Wave"]
    body = [[f"SRV-2026-{i:04d}", (i % 21 - 10) / 10, f"{i % 101}%", (i % 11) / 10, f"Comment {i}", f"BMS-{i % 7}", f"Agent {i % 7}", f"Lead {i % 3}", 46023 + i % 30, f"Wave {i % 4}"] for i in range(1, rows + 1)]
    write_workbook(path, {"Surveys": [["Sample export"], [], [], header, *body], "Notes": [["Generated"]]})


def write_csv(table: DataFrame, path: str) -> None:
    """Quoted CSV with CRLF line ends and a header in every part."""
    table.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def csv_text(rows: list[dict]) -> str:
    """A small result as one CSV text with a byte order mark."""
    if not rows:
        return "﻿"
    quote = lambda v: '"' + ("" if v is None else str(v)).replace('"', '""') + '"'
    lines = [",".join(map(quote, rows[0])), *(",".join(quote(v) for v in r.values()) for r in rows)]
    return "﻿" + "\r\n".join(lines) + "\r\n"
