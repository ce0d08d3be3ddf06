"""A data source for survey files: CSV with lines before the header, and workbooks.

    spark.dataSource.register(SurveyFiles)
    spark.read.format("survey_file").option("header_row", 4).option("sheet", "Surveys").load(path)

Options: ``header_row`` (1), ``sheet`` (workbooks; the first one), ``names`` (``header``, or
``letters`` for column letters).  The header is a place, not a text: rows before it are left
out by their number, so rows below that look like them stay.  All columns are text; ``_file``
and ``_row`` (number in the sheet or file) come with them.  A path is a file, a folder, or
a pattern in a folder; each file is one task, as line breaks inside quotes leave no safe
place to cut, and columns of several files meet by name.  Old binary workbooks are refused.
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from surveyloom.sources.files import LARGEST_WORKBOOK, _cells, _sheets

#: Rows of an Arrow batch.
BATCH = 2000
#: Bytes that are hashed together.
PIECE = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a path, a folder or a pattern, by name."""
    from pyarrow import fs

    store, inner = _store(path)
    outer = path[: len(path) - len(inner)]
    folder, _, pattern = inner.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    else:
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [inner] if info.type == fs.FileType.File else [i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return [outer + p for p in sorted(found)]


def letter(i: int) -> str:
    """Letters of a column: A, B, ..., Z, AA, ..."""
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _rows(path: str, sheet: str | None) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, {letter: text}) of a file; blank cells are left out."""
    kind = path.rpartition(".")[2].lower()
    if kind == "xls":
        raise ValueError(f"{path}: old binary workbooks have to be saved as xlsx or CSV")
    store, inner = _store(path)
    if kind in ("xlsx", "xlsm"):
        if store.get_file_info(inner).size > LARGEST_WORKBOOK:
            raise ValueError(f"{path}: workbooks of more than 50 MB have to be saved as CSV")
        with store.open_input_file(inner) as stream, zipfile.ZipFile(stream) as book:
            parts = _sheets(book)
            if sheet is not None and sheet not in parts:
                raise ValueError(f"{path}: no sheet {sheet!r} among {sorted(parts)}")
            yield from _cells(book, parts[sheet] if sheet is not None else next(iter(parts.values())))
        return
    with store.open_input_stream(inner) as stream:
        for number, cells in enumerate(csv.reader(io.TextIOWrapper(io.BufferedReader(_Raw(stream), PIECE), "utf-8-sig", newline="")), 1):
            yield number, {letter(i): c for i, c in enumerate(cells) if c != ""}


class _Raw(io.RawIOBase):
    """An Arrow stream as Python's reader wants it."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def _names(header: dict[str, str], by_letter: bool) -> dict[str, str]:
    """Letter to column name: the trimmed header; its letter tells equal or blank ones apart."""
    if by_letter:
        return {k: k for k in header}
    out: dict[str, str] = {}
    for k, text in header.items():
        name = text.strip() or k
        out[k] = name if name not in out.values() else f"{name}_{k}"
    return out


def _header(path: str, sheet: str | None, row: int, by_letter: bool) -> dict[str, str]:
    for number, cells in _rows(path, sheet):
        if number >= row:
            return _names(cells, by_letter) if number == row else {}
    return {}


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], sheet: str | None, header_row: int, by_letter: bool) -> None:
        self.paths, self.columns, self.sheet, self.header_row, self.by_letter = paths, columns, sheet, header_row, by_letter

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_file", pa.string()), ("_row", pa.int64()), *((c, pa.string()) for c in self.columns)])
        names: dict[str, str] = {}
        held: list[dict] = []
        for number, cells in _rows(partition.path, self.sheet):
            if number == self.header_row:
                names = _names(cells, self.by_letter)
            elif number > self.header_row and cells:
                held.append({"_file": partition.path, "_row": number} | {names[k]: v for k, v in cells.items() if k in names})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class SurveyFiles(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "survey_file"

    def _asked(self) -> tuple[list[str], str | None, int, bool]:
        names = self.options.get("names", "header")
        if names not in ("header", "letters"):
            raise ValueError("names must be header or letters")
        return listed(self.options["path"]), self.options.get("sheet"), int(self.options.get("header_row", "1")), names == "letters"

    def schema(self) -> str:
        paths, sheet, row, by_letter = self._asked()
        columns = list(dict.fromkeys(n for p in paths for n in _header(p, sheet, row, by_letter).values()))
        return ", ".join(["_file string", "_row bigint", *(f"`{c.replace('`', '``')}` string" for c in columns)])

    def reader(self, schema) -> _Reader:
        return _Reader(self._asked()[0], [f.name for f in schema.fields if f.name not in ("_file", "_row")], *self._asked()[1:])


def read_survey_files(spark: SparkSession, path: str, header_row: int = 1, sheet: str | None = None, names: str = "header") -> DataFrame:
    spark.dataSource.register(SurveyFiles)
    reader = spark.read.format("survey_file").option("header_row", str(header_row)).option("names", names)
    return (reader.option("sheet", sheet) if sheet is not None else reader).load(path)


def preview(spark: SparkSession, path: str, header_row: int = 1, sheet: str | None = None, limit: int = 20) -> dict:
    """Headers by column letter, the first rows, and how many rows there are below the header."""
    table = read_survey_files(spark, path, header_row, sheet, "letters")
    rows = [r.asDict() for r in table.orderBy("_file", "_row").limit(limit).collect()]
    highest = table.agg(F.max("_row")).first()[0] or 0
    first = listed(path)[0]
    return {"headers": next((dict(cells) for n, cells in _rows(first, sheet) if n == header_row), {}), "rows": rows, "total_rows": max(0, highest - header_row)}


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file of a folder or pattern; files stream through their tasks in pieces."""
    paths = listed(path)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                store, inner = _store(p)
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(inner, compression=None) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                out.append((p, size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    return files.mapInArrow(run, "path string, bytes long, sha256 string")
