"""Cells of workbooks and delimited files, as a Spark data source named `cells`.

spark.read.format("cells").load(path or glob) gives file, sheet, sheet_no, row (from 1), cells ARRAY<STRING>
and kinds ARRAY<STRING> (str, num, bool, blank). Options: sheet (only that one), split_bytes, delimiter. A workbook larger
than split_bytes has a task for each of its sheets, which unpacks that sheet alone; smaller files share tasks.
`read_cells` gives the same; there, what filters on file, and on sheet and sheet_no of large workbooks, rule out is not
opened, and large delimited files are read by byte ranges (`splits`).
"""

from __future__ import annotations

import csv
import fnmatch
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, sheet_no int, row int, cells array<string>, kinds array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
csv.field_size_limit(1 << 30)
_NUMBER = re.compile(r"-?\d+(\.\d+)?\Z")


class UnreadableError(ValueError):
    """A file that is no workbook, or of a kind that isn't read."""


def column_number(letters: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _trim(row: list[tuple[str, str]]) -> list[tuple[str, str]]:
    while row and row[-1][0] == "":
        row.pop()
    return row


def sniff_delimiter(text: str) -> str:
    """The most frequent of tab, semicolon and comma in the first line that has text; the first of equals."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    return max("\t;,", key=line.count) if any(c in line for c in "\t;,") else ","


def parse_delimited(text: str, delimiter: str | None = None) -> list[list[tuple[str, str]]]:
    """Rows of (text, kind). Blank lines drop out, so rows are numbered without them."""
    text = text.removeprefix("﻿")
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or sniff_delimiter(text))
    return [cells for cells in map(as_cells, rows) if any(x.strip() for x, _ in cells)]


def as_cells(row: list[str]) -> list[tuple[str, str]]:
    return _trim([(x, "num" if _NUMBER.match(x) else "str" if x else "blank") for x in row])


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _cell(node: ET.Element, shared: list[str]) -> tuple[str, str]:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")), "str"
    held = node.find(f"{_MAIN}v")
    text = held.text if held is not None and held.text else ""
    if text == "":
        return "", "blank"
    if kind == "s":
        return shared[int(text)] if int(text) < len(shared) else "", "str"
    if kind == "b":
        return ("true" if text == "1" else "false"), "bool"
    return text, "str" if kind in ("str", "e") else "num"


def parse_sheet(xml: bytes, shared: list[str]) -> dict[int, list[tuple[str, str]]]:
    """Rows by number."""
    out: dict[int, list[tuple[str, str]]] = {}
    at = 0
    for _, row in ET.iterparse(io.BytesIO(xml)):
        if row.tag != f"{_MAIN}row":
            continue
        at = int(row.get("r", at + 1))
        cells: list[tuple[str, str]] = []
        for node in row.iter(f"{_MAIN}c"):
            ref = re.match(r"[A-Za-z]+", node.get("r", ""))
            place = column_number(ref[0]) if ref else len(cells)
            cells += [("", "blank")] * (place - len(cells))
            cells[place : place + 1] = [_cell(node, shared)]
        out[at] = _trim(cells)
        row.clear()  # the tree never holds more than a row's cells
    return out


def parse_workbook(data, only: str | None = None, wanted=lambda name, number: True) -> Iterator[tuple[str, int, int, list[tuple[str, str]]]]:
    """(sheet, number, row, cells) of a workbook (bytes, or a file that can seek); only sheets that are asked for are unpacked."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    except zipfile.BadZipFile as e:
        raise UnreadableError("not a workbook (a damaged or unfinished archive)") from e
    with book:
        if "xl/workbook.xml" not in book.namelist():
            raise UnreadableError("not a workbook (an archive without xl/workbook.xml)")
        targets = {}
        if "xl/_rels/workbook.xml.rels" in book.namelist():
            targets = {x.get("Id"): x.get("Target", "") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared = _shared(book)
        for number, sheet in enumerate(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            name = sheet.get("name", f"Sheet{number + 1}")
            target = targets.get(sheet.get(_REL), f"worksheets/sheet{number + 1}.xml").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if (only is not None and name.lower() != only.lower()) or not wanted(name, number) or part not in book.namelist():
                continue
            for row, cells in sorted(parse_sheet(book.read(part), shared).items()):
                if cells:
                    yield name, number, row, cells


def sheet_names(f) -> list[str]:
    """The sheets of a workbook file, from its directory and one small part; none if it isn't one."""
    try:
        with zipfile.ZipFile(f) as book:
            return [x.get("name", f"Sheet{k}") for k, x in enumerate(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), 1)]
    except (zipfile.BadZipFile, KeyError, ValueError, OSError):  # pyarrow's files raise these where a short file has no directory
        return []


def parse(data: bytes, name: str = "", sheet: str | None = None, delimiter: str | None = None) -> Iterator[tuple[str, int, int, list[tuple[str, str]]]]:
    """Rows of a file by its first bytes and its name."""
    if data[:2] == b"PK":
        yield from parse_workbook(data, sheet)
    elif data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise UnreadableError("an old binary workbook (.xls): save it as .xlsx or .csv")
    else:
        for row, cells in enumerate(parse_delimited(data.decode("utf-8-sig", "replace"), delimiter or ("\t" if name.lower().endswith(".tsv") else None)), 1):
            yield "Sheet1", 0, row, cells


def place(path: str):
    """(file system, path) of an address: anything that pyarrow knows, else a local path."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def _listed(path: str) -> list[str]:
    """Files of an address: itself, those of a folder, or those that a pattern in its last part fits."""
    import pyarrow.fs as pafs

    fs, base = place(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    folder, _, last = base.rpartition("/")
    if any(c in last for c in "*?["):
        held = [x.path for x in fs.get_file_info(pafs.FileSelector(folder or "/")) if fnmatch.fnmatch(x.base_name, last)]
    elif fs.get_file_info(base).type == pafs.FileType.Directory:
        held = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.extension.lower() in ("xlsx", "xlsm", "csv", "tsv")]
    else:
        held = [base]
    return [prefix + x for x in sorted(held) if not os.path.basename(x).startswith("~$")]


#: Bytes of a file from which on its sheets are read by tasks of their own, and of small files that share a task.
SPLIT_BYTES = 32 << 20
_DELIMITED = (".csv", ".tsv")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sheet = options.get("sheet")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.paths = _listed(options.get("path", ""))
        self.delimiter = options.get("delimiter")

    def partitions(self):
        """Each a list of (file, number of its sheet or None for all)."""
        out, small, size = [], [], 0
        for path in self.paths:
            fs, base = place(path)
            n = fs.get_file_info(base).size
            if n > self.split and not path.lower().endswith(_DELIMITED):
                with fs.open_input_file(base) as f:
                    names = sheet_names(f)
                if names:
                    out += [InputPartition([(path, k)]) for k, name in enumerate(names) if self.sheet is None or name.lower() == self.sheet.lower()]
                    continue
            if small and size + n > self.split:
                out.append(InputPartition(small))
                small, size = [], 0
            small, size = [*small, (path, None)], size + n
        return [*out, InputPartition(small)]

    def read(self, partition):
        for file, only in partition.value:
            yield from _read(file, only, self.sheet, self.delimiter)


def _read(file: str, number: int | None, sheet: str | None, delimiter: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA of a file, or of its sheet of that number."""
    fs, path = place(file)
    with fs.open_input_file(path) as f:
        rows = parse(f.readall(), file, sheet, delimiter) if number is None else parse_workbook(f, sheet, lambda _, k: k == number)
        for name, k, row, cells in rows:
            yield file, name, k, row, [x for x, _ in cells], [kind for _, kind in cells]


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _opened(spark: SparkSession, listed: list[tuple], sheet: str | None, delimiter: str | None) -> DataFrame:
    """Cells of listed (file, sheet, sheet_no) or, where these two are None, of whole files. Spark takes filters on what is listed off the list, for each use of the frame apart."""
    import pyarrow as pa

    whole = listed[0][1] is None
    own = SCHEMA.partition(", ")[2] if whole else "row int, cells array<string>, kinds array<string>"

    class Opened:
        def eval(self, file: str, number: int | None):
            for row in _read(file, number, sheet, delimiter):
                yield row[1:] if whole else row[3:]

    kinds = pa.schema([("file", pa.string()), ("_sheet" if whole else "sheet", pa.string()), ("_number" if whole else "sheet_no", pa.int32())])
    names = spark.createDataFrame(pa.table(list(map(list, zip(*listed, strict=True))), schema=kinds))
    rows = F.udtf(Opened, returnType=own).asDeterministic()(F.col("file").outer(), F.col(kinds.names[2]).outer())
    return names.lateralJoin(rows).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, split_bytes: int = SPLIT_BYTES, delimiter: str | None = None) -> DataFrame:
    """Cells of files: one, a folder's, or those that a pattern in the last part of the path fits; any file system that pyarrow knows. Delimited files over split_bytes are read by byte ranges, larger workbooks by sheets. delimiter: that of delimited files, else told from their first line.

    The files (and sheets of large workbooks) are a list that Spark filters before anything is opened. The data source's
    own hook for filters isn't used: Spark keeps what was pushed with the relation, so that one use of a frame would be
    filtered as another was.
    """
    import pyarrow as pa

    from .splits import read_ranges

    whole, apart, odd, large = [], [], [], []
    for p in _listed(path):
        fs, base = place(p)
        if fs.get_file_info(base).size <= split_bytes:
            whole.append((p, None, None))
        elif p.lower().endswith(_DELIMITED):
            large.append(p)
        else:
            with fs.open_input_file(base) as f:
                names = sheet_names(f)
            held = [(p, name, k) for k, name in enumerate(names) if sheet is None or name.lower() == sheet.lower()]
            apart, odd = apart + held, odd if names else [*odd, (p, None, None)]
    parts = [_opened(spark, x, sheet, delimiter) for x in (whole, apart) if x]
    if odd:  # large and no workbooks: the join lets Spark leave all of this out where a filter rules these files out
        parts.append(_opened(spark, odd, sheet, delimiter).join(F.broadcast(spark.createDataFrame(pa.table({"file": [p for p, _, _ in odd]}))), "file"))
    parts += ([read_ranges(spark, large, split_bytes, delimiter)] if large else [])
    out = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def read_cells_anywhere(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The same through Spark's binaryFile source, for any store that Spark reads."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("kinds", pa.list_(pa.string()))])
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(file, s, n, r, [x for x, _ in c], [k for _, k in c]) for s, n, r, c in parse(content, file, sheet)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.{xlsx,xlsm,csv,tsv}").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_bytes(spark: SparkSession, data: bytes, name: str, sheet: str | None = None) -> DataFrame:
    """Cells of a file that is at hand as bytes."""
    rows = [(name, s, n, r, [x for x, _ in c], [k for _, k in c]) for s, n, r, c in parse(data, name, sheet)]
    return spark.createDataFrame(rows, SCHEMA)
