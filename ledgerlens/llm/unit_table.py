"""A table of a corpus' distinct units (words, or parts of them), each segmented by a tokenizer once.

1. Tasks send the distinct units of the texts they see, with counts, dealt out by hash.
2. Each bucket has a unit once, has the tokenizer segment it, and writes a sorted hash array with the
   values of each unit behind it into the shared folder.
3. Whoever needs texts' values looks up the distinct hashes of a large piece of text in sorted order,
   bucket by bucket (the files are memory-mapped where the store is a file system), and joins them back by
   position.

Units are found by hash and told apart by their bytes, which the table holds too: of two units of one hash
the table has one, and the other counts as not there. A unit that isn't in the table (for this reason, or
where texts aren't the same when they are read again) is segmented on the spot, so the table is never a
condition of right results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, blob_of, buckets, cut, file_system, in_parts, make_folder, mapped, narrow, on_workers, pieces, scale, tidy, wide

#: Distinct units that a task gathers before it sends them, and units of text that it looks up at once.
GATHERED, LOOKED_UP = 1_000_000, 1_000_000
#: Units that the tokenizer gets in one call.
CALL = 20_000
_SENT = pa.schema([("bucket", pa.int32()), ("counts", pa.binary()), ("lengths", pa.binary()), ("bytes", pa.binary())])
_SENT_SQL = "bucket int, counts binary, lengths binary, bytes binary"


class Segmenter(Protocol):
    """What a tokenizer has to say: how texts fall into units, and the values of units."""

    kind: str

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words: ...

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many values each unit has, all values)."""


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))


def same_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Whether data[start:start + length] and other's piece are the same, for each pair: eight bytes at a time."""
    same = length == other_length
    left, right = _eights(data), _eights(other)
    more, at = np.flatnonzero(same), 0
    while len(more):
        mask = _MASKS[np.minimum(length[more] - at, 8)]
        alike = ((left[start[more] + at] ^ right[other_start[more] + at]) & mask) == 0
        same[more[~alike]] = False
        more = more[alike & (length[more] > at + 8)]
        at += 8
    return same


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each hash the number of its value, the distinct values, where each is first)."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, values, first


def distinct_units(hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each unit the number of its bytes, their hashes, where each is first): units of one hash that differ have numbers of their own."""
    codes, values, first = distinct(hashes)
    length = end - start
    shown = first[codes]
    odd = np.flatnonzero(~same_bytes(data, start, length, data, start[shown], length[shown]))
    if len(odd):
        known: dict[bytes, int] = {}
        more: list[int] = []
        for k in odd.tolist():
            unit = data[start[k] : end[k]].tobytes()
            if unit not in known:
                known[unit] = len(values) + len(more)
                more.append(k)
            codes[k] = known[unit]
        first = np.append(first, more)
        values = np.append(values, hashes[more])
    return codes, values, first


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start + length] for each start, end to end."""
    stop = np.cumsum(length)
    return values[np.repeat(start - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]


def _once(hashes: np.ndarray, counts: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with summed counts, lengths and bytes."""
    codes, values, first = distinct_units(hashes, data, start, end)
    length = (end - start)[first]
    return values, np.bincount(codes, counts, len(values)).astype(np.int64), length, gathered(data, start[first], length)


@tidy
def _send(segmenter: Callable[[], Segmenter], n: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut_up, held, size = segmenter(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        hashes, counts, length, data = (np.concatenate([x[k] for x in held]) for k in range(4))
        held.clear()
        stop = np.cumsum(length)
        hashes, counts, length, data = _once(hashes, counts, stop - length, stop, data)
        start = np.cumsum(length) - length
        order = np.argsort(hashes)
        stops = np.searchsorted(scale(hashes[order], n), np.arange(n + 1).astype(np.uint64))
        rows = [(k, narrow(counts[at]), narrow(length[at]), blob_of(gathered(data, start[at], length[at]))) for k in np.flatnonzero(np.diff(stops)).tolist() for at in (order[stops[k] : stops[k + 1]],)]
        yield from in_parts(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT))

    for batch in batches:
        for _, data, offsets in pieces(batch):
            units = cut_up.units(data, offsets)
            if len(units.start):
                held.append(_once(units.hashes(), np.ones(len(units.start), np.int64), units.start, units.end, units.data))
                size += len(held[-1][0])
            if size >= most:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _texts(data: np.ndarray, stop: np.ndarray) -> list[str]:
    held = data.tobytes()
    return [held[a:b].decode() for a, b in zip(np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True)]


def _segmented(segmenter: Segmenter, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many values, all values) of units that lie end to end in data."""
    stop, parts = np.cumsum(length), []
    for at in range(0, len(length), CALL):
        mine = slice(at, at + CALL)
        begin = int(stop[at] - length[at])
        parts.append(segmenter.segment(_texts(data[begin : stop[mine][-1]], stop[mine] - begin)))
    return np.concatenate([np.empty(0, np.int64), *(x[0] for x in parts)]), np.concatenate([np.empty(0, segmenter.kind), *(x[1] for x in parts)])


@tidy
def _save(segmenter: Callable[[], Segmenter], folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's files, and what it adds to the counts of values (values, then counts)."""
    fs, base = file_system(folder)
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, counts, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append((wide(counts), wide(lengths), np.frombuffer(data, np.uint8)))
    for bucket in sorted(held):
        counts, length, data = (np.concatenate([x[k] for x in held[bucket]]) for k in range(3))
        del held[bucket]
        stop = np.cumsum(length)
        hashes, counts, length, data = _once(Words(data, stop - length, stop, np.array([0, len(stop)])).hashes(), counts, stop - length, stop, data)
        order = np.argsort(hashes, kind="stable")
        data, length = gathered(data, (np.cumsum(length) - length)[order], length[order]), length[order]
        how_many, values = _segmented(segmenter(), data, length)
        name = f"units-{uuid.uuid4().hex}"
        for end, content in (("key", hashes[order]), ("first", np.append(0, np.cumsum(how_many)).astype("<u8")), ("value", values), ("at", np.append(0, np.cumsum(length)).astype("<u8")), ("bytes", data)):
            with fs.open_output_stream(f"{base}/{name}.{end}") as f:
                f.write(blob_of(content))
        used, at = np.unique(values, return_inverse=True)
        total = np.bincount(at, np.repeat(counts[order], how_many), len(used)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([blob_of(used.astype("<i8"))], pa.binary()), pa.array([blob_of(total)], pa.binary())], names=["bucket", "name", "used", "total"])


@dataclass
class UnitTable:
    """The files of each bucket of hashes ('' if none)."""

    folder: str
    names: list[str]
    kind: str

    def look_up(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many values each of distinct units has, -1 if it isn't here; where its values begin; values)."""
        fs, base = file_system(self.folder)
        order, n = np.argsort(hashes, kind="stable"), len(self.names)
        wanted, start, sized = hashes[order], start[order], length[order]
        many, parts = np.full(len(hashes), -1, np.int64), [np.empty(0, self.kind)]
        stops = np.searchsorted(scale(wanted, n), np.arange(n + 1).astype(np.uint64))
        for k in np.flatnonzero(np.diff(stops)):
            if not self.names[k]:
                continue
            key, first, value, place, held = (mapped(fs, f"{base}/{self.names[k]}.{end}", kind) for end, kind in (("key", np.uint64), ("first", "<u8"), ("value", self.kind), ("at", "<u8"), ("bytes", np.uint8)))
            own = slice(stops[k], stops[k + 1])
            mine = wanted[own]
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            found = key[at] == mine
            there = place[at].astype(np.int64)
            long = place[at + 1].astype(np.int64) - there
            found &= same_bytes(data, start[own], sized[own], gathered(held, there, long), np.cumsum(long) - long, long)
            begin = first[at].astype(np.int64)
            length = np.where(found, first[at + 1].astype(np.int64) - begin, 0)
            parts.append(gathered(value, begin, length))
            many[stops[k] : stops[k + 1]] = np.where(found, length, -1)
        length = np.maximum(many, 0)
        begin = np.cumsum(length) - length
        out_many, out_begin = np.empty_like(many), np.empty_like(begin)
        out_many[order], out_begin[order] = many, begin
        return out_many, out_begin, np.concatenate(parts)

    def values(self, segmenter: Segmenter, units: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(for each unit of some texts the number of its distinct value; of those: how many values, where they begin; values)."""
        codes, hashes, first = distinct_units(units.hashes(), units.data, units.start, units.end)
        start, length = units.start[first], (units.end - units.start)[first]
        many, begin, values = self.look_up(hashes, units.data, start, length)
        new = np.flatnonzero(many < 0)
        if len(new):
            more, added = _segmented(segmenter, gathered(units.data, start[new], length[new]), length[new])
            many[new] = more
            begin[new] = np.cumsum(more) - more + len(values)
            values = np.concatenate([values, added])
        return codes, many, begin, values


def build(docs: DataFrame, segmenter: Callable[[], Segmenter], folder: str, kind: str, *, gathered: int = GATHERED) -> tuple[UnitTable, DataFrame]:
    """The table of docs' text column, and by bucket the counts of values over all texts (used, total: binary numbers)."""
    on_workers(docs.sparkSession)
    make_folder(docs.sparkSession, folder)
    n = buckets(docs)
    sent = docs.select(docs["text"].alias("text")).mapInArrow(lambda b: _send(segmenter, n, gathered, b), _SENT_SQL).repartitionById(n, "bucket")
    written = cut(sent.mapInArrow(lambda b: _save(segmenter, folder, b), "bucket int, name string, used binary, total binary"))
    names = [""] * n
    # one row per bucket, that is per megabytes of input
    for row in written.select("bucket", "name").collect():
        names[row.bucket] = row["name"]
    return UnitTable(folder, names, kind), written.select("used", "total")
