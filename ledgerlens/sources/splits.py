"""Delimited files of any size, read by byte ranges.

A line end inside quotes doesn't end a row, so a range alone can't tell where its rows begin. Each range is surveyed
under both assumptions (its first line begins a row, or goes on inside quotes): how many rows begin in it, and in which
state its successor begins. One row a range goes to the driver, which follows the states from the first range on; then
every range is read in its true state and numbers its rows from the sum of those before it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .cells import SCHEMA, as_cells, place, sniff_delimiter

_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\n|\r)")
_BLOCK = 1 << 17


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place behind it, line with its end) of the lines from a line's begin on."""
    f.seek(at)
    held = b""
    while True:
        more = f.read(_BLOCK)
        held += more
        done = 0
        for m in _LINE.finditer(held):
            if m.end() == len(held) and held.endswith(b"\r") and more:
                break  # a line feed may follow
            done = m.end()
            yield at + done, m[0]
        at, held = at + done, held[done:]
        if not more:
            if held:
                yield at + len(held), held
            return


def line_begin(f, at: int) -> int:
    """The first place from `at` on where a line begins (the file's end if none does)."""
    if at == 0:
        return 0
    f.seek(at - 1)
    held, base = f.read(_BLOCK), at - 1
    while held:
        for m in re.finditer(rb"\r\n|\n|\r", held):
            if m.end() == len(held) and held.endswith(b"\r"):
                break
            if base + m.end() >= at:
                return base + m.end()
        more = f.read(_BLOCK)
        if not more:
            return base + len(held)
        keep = held[-1:] if held.endswith(b"\r") else b""
        base, held = base + len(held) - len(keep), keep + more
    return base


class _Fed:
    """Lines as csv takes them, with the place reached. inside: the first of them goes on inside quotes."""

    def __init__(self, f, at: int, inside: bool):
        self.at, self.lines, self.opening = at, _lines(f, at), inside

    def __iter__(self) -> _Fed:
        return self

    def __next__(self) -> str:
        if self.opening:
            self.opening = False
            return '"'
        first = self.at == 0
        self.at, line = next(self.lines)
        return line.decode("utf-8-sig", "replace").removeprefix("﻿") if first else line.decode("utf-8", "replace")


def rows_from(f, at: int, stop: int, inside: bool, delimiter: str) -> Iterator[tuple[list[str], int]]:
    """(row, place behind it) of the rows that begin from `at` to before `stop`; the row that `at` lies inside belongs to those before."""
    fed = _Fed(f, at, inside)
    reader = csv.reader(fed, delimiter=delimiter)
    if inside and next(reader, None) is None:
        return
    while fed.at < stop:
        row = next(reader, None)
        if row is None:
            return
        yield row, fed.at


def _kept(row: list[str]) -> bool:
    return any(x.strip() for x in row)


def survey(f, start: int, stop: int, inside: bool, delimiter: str) -> tuple[int, bool]:
    """(rows with text that begin in the range, whether the next range begins inside quotes)."""
    fed = _Fed(f, start, inside)
    reader, kept = csv.reader(fed, delimiter=delimiter), 0
    if inside and next(reader, None) is None:
        return 0, True
    if fed.at > stop or (inside and fed.at == stop and start == stop):
        return 0, True
    while fed.at < stop:
        row = next(reader, None)
        if row is None:
            break
        kept += _kept(row)
    return kept, fed.at > stop


_SURVEY = "file string, number int, start long, stop long, outside long, outside_ends boolean, inside long, inside_ends boolean"


def _delimiter(path: str, f) -> str:
    if path.lower().endswith(".tsv"):
        return "\t"
    f.seek(0)
    held = f.read(_BLOCK)
    while True:
        text = held.decode("utf-8-sig", "replace").removeprefix("﻿")
        lines = text.splitlines()
        if any(x.strip() for x in lines[:-1]):
            return sniff_delimiter(text)
        more = f.read(_BLOCK)
        if not more:
            return sniff_delimiter(text)
        held += more


def read_ranges(spark: SparkSession, paths: list[str], split_bytes: int, delimiter: str | None = None) -> DataFrame:
    """Cells of delimited files by ranges of about split_bytes, which tasks share where there are many. A file's delimiter is told once (delimiter: as given)."""
    ranges, marks = [], {}
    for path in paths:
        fs, base = place(path)
        size = fs.get_file_info(base).size
        with fs.open_input_file(base) as f:
            marks[path] = delimiter or _delimiter(path, f)
        ranges += [(path, k, at, min(at + split_bytes, size)) for k, at in enumerate(range(0, size, split_bytes))]
    tasks = 8 * spark.sparkContext.defaultParallelism
    dealt = spark.createDataFrame(ranges, "file string, number int, start long, stop long").repartition(max(1, min(len(ranges), tasks)), "file", "number")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for r in batch.to_pylist():
                fs, base = place(r["file"])
                with fs.open_input_file(base) as f:
                    start, stop = line_begin(f, r["start"]), line_begin(f, r["stop"])
                    outside, ends = survey(f, start, stop, False, marks[r["file"]])
                    inside, inside_ends = survey(f, start, stop, True, marks[r["file"]]) if r["number"] else (0, False)
                yield pa.RecordBatch.from_pylist([{"file": r["file"], "number": r["number"], "start": start, "stop": stop, "outside": outside, "outside_ends": ends, "inside": inside, "inside_ends": inside_ends}], schema=_schema(_SURVEY))

    told = []
    state, before, last = False, 0, None
    for r in sorted(dealt.mapInArrow(look, _SURVEY).collect(), key=lambda r: (r["file"], r["number"])):  # a row a range
        if r["file"] != last:
            state, before, last = False, 0, r["file"]
        if r["start"] < r["stop"]:
            told.append((r["file"], r["start"], r["stop"], state, before))
            before += r["inside"] if state else r["outside"]
            state = r["inside_ends"] if state else r["outside_ends"]
    true = spark.createDataFrame(told, "file string, start long, stop long, inside boolean, before long").repartition(max(1, min(len(told), tasks)), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for r in batch.to_pylist():
                fs, base = place(r["file"])
                with fs.open_input_file(base) as f:
                    row, held = r["before"], []
                    for cells, _ in rows_from(f, r["start"], r["stop"], r["inside"], marks[r["file"]]) if r["start"] < r["stop"] else ():
                        if _kept(cells):
                            row += 1
                            pairs = as_cells(cells)
                            held.append({"file": r["file"], "sheet": "Sheet1", "sheet_no": 0, "row": row, "cells": [x for x, _ in pairs], "kinds": [k for _, k in pairs]})
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=_schema(SCHEMA))
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_schema(SCHEMA))

    return true.mapInArrow(read, SCHEMA)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
