"""Token ids in binary files: frequency-ranked, byte-aligned variable length, control bytes apart.

Each distinct word of the corpus goes through the library once (`unit_table`), which also gives how often each
id occurs, so ids are renumbered by falling frequency before any text is encoded. Texts are then encoded by
look-ups and sent to their part of the doc_id order. Files hold documents in ascending doc_id: a file is

    magic, counts | doc ids | ids per document | control bytes (2 bits an id: bytes - 1) | data bytes

and a folder has one `ranks.bin` with the id of each rank. A numpy table over the control bytes gives
the four lengths of each, so decoding is cumulative sums and gathers, no loop over ids.

Defined results: null and empty texts have no ids but the end id. Rows with a null doc_id come first,
rows that share a doc_id follow each other in no defined order (many of them go to several parts). A text of
any length is one row, its ids one value. An empty table gives an empty result; extra columns are ignored. A
task that is run again writes a new file; only files that the surviving attempts name are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, SPACED_LOWER, Words, buckets, cut, drop_folder, file_system, in_parts, mapped, new_folder, on_workers, pieces, tidy, words_of
from .unit_table import GATHERED, LOOKED_UP, build, gathered

MAGIC = b"LLTOK001"
#: Bytes of stored ids in a file, about.
FILE_BYTES = 64 << 20
NULL_ID = np.iinfo(np.int64).min
#: Signs that may close a word; no apostrophe (contractions) and no '|' or '>' (special tokens).
SIGNS = ".,;:!?#*$%&-)"
#: Closing signs that are taken from a word, at most.
CLOSING = 8
_IS_SIGN = np.isin(np.arange(256), list(SIGNS.encode()))
#: Bytes of no letter that is ASCII or begins with C3 (second bytes 97 and B7 of that are signs; other first bytes tell for the bytes behind them).
_IS_OTHER = ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))])
_LOADED: dict[str, WordUnits] = {}
#: For each control byte the lengths of its four values, and their sum.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)
TOTALS = LENGTHS.sum(1).astype(np.uint8)


class WordUnits:
    """The library's ids of texts by way of units: chunks between ASCII white space, those of letters and closing signs in two parts.

    The tokenizer drops white space, cuts between letters and signs, and lower-cases, so the parts' ids in turn are the text's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        words = words_of(data, offsets, SPACED)
        core = words.end.copy()
        closing = np.arange(len(core))
        for _ in range(CLOSING):
            closing = closing[core[closing] > words.start[closing]]
            closing = closing[_IS_SIGN[data[core[closing] - 1]]]
            core[closing] -= 1
        # letters are ASCII ones and those of two bytes that begin with C3; the rest stays as it is
        other = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(_IS_OTHER[data], out=other[1:])
        plain = (other[core] == other[words.start]) & (core > words.start)
        plain[closing] = False  # more signs than were looked at
        two = plain & (core < words.end)
        n = 1 + two
        at = np.cumsum(n) - n
        start, end = np.empty(n.sum(), np.int64), np.empty(n.sum(), np.int64)
        # behind the text stands the same in small letters
        start[at] = words.start + np.where(plain, len(data), 0)
        end[at] = np.where(plain, core + len(data), words.end)
        start[at[two] + 1], end[at[two] + 1] = core[two], words.end[two]
        return Words(np.concatenate([data, SPACED_LOWER[1][data]]), start, end, np.append(0, np.cumsum(n))[words.first])

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), self.kind)


def units_for(path: str) -> WordUnits:
    if path not in _LOADED:
        _LOADED[path] = WordUnits(path)
    return _LOADED[path]


# ---- the coding --------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = length - 1
    fours = padded.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    length = LENGTHS[control].ravel()[:n]
    stop = np.cumsum(length, dtype=np.int64)
    start = stop - length
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(fs, path: str, ids: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
    control, data = pack(values)
    with fs.open_output_stream(path) as f:
        f.write(MAGIC + np.array([len(ids), len(values), len(data)], "<u8").tobytes())
        for part in (ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control, data):
            f.write(part)


def read_file(fs, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ranks) of a file."""
    held = mapped(fs, path, np.uint8)
    if held[:8].tobytes() != MAGIC:
        raise ValueError(f"{path} is no token file")
    n_docs, n, n_data = (int(x) for x in held[8:32].view("<u8"))
    at = 32
    parts = []
    for size in (8 * n_docs, 4 * n_docs, -(-n // 4), n_data):
        parts.append(np.asarray(held[at : at + size]))
        at += size
    return parts[0].view("<i8"), parts[1].view("<u4"), unpack(parts[2], parts[3], n)


# ---- Spark -------------------------------------------------------------------------------------


@tidy
def _encode(path: str, shared: Broadcast, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the ranks of their ids and the part of the doc_id order that they go to."""
    table, rank, end_id, bounds = shared.value
    segmenter = units_for(path)
    kind = "<u2" if len(rank) <= 1 << 16 else "<u4"
    held: list[tuple[np.ndarray, Words]] = []
    turn = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        shift = np.cumsum([0, *(len(x.data) for _, x in held)])
        n_units = np.cumsum([0, *(len(x.start) for _, x in held)])
        units = Words(*(np.concatenate([getattr(x, f) + s if f != "data" else x.data for (_, x), s in zip(held, shift, strict=False)]) for f in ("data", "start", "end")), np.concatenate([*(x.first[:-1] + s for (_, x), s in zip(held, n_units, strict=False)), n_units[-1:]]))
        ids = np.concatenate([x for x, _ in held])
        held.clear()
        codes, many, begin, values = table.values(segmenter, units)
        # each document is closed by the end id
        order = np.full(len(codes) + len(ids), len(many), np.int64)
        order[np.arange(len(codes)) + units.owner()] = codes
        many, begin = np.append(many, 1), np.append(begin, len(values))
        ranks = gathered(rank[np.append(values.astype(np.int64), end_id)].astype(kind), begin[order], many[order])
        stops = np.append(0, np.cumsum(many[order])[units.first[1:] + np.arange(len(ids))])
        low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, side="right")
        part = low + (turn + np.arange(len(ids))) % (high - low + 1)  # an id that is several bounds goes to all parts between
        turn += len(ids)
        size = np.dtype(kind).itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((stops * size).astype("<i4")), pa.py_buffer(ranks)])
        yield from in_parts(pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(ids), pa.array(np.diff(stops)), blobs], names=["part", "doc_id", "n", "ranks"]))

    size = 0
    for batch in batches:
        for part, data, offsets in pieces(batch):
            held.append((pc.fill_null(part.column("doc_id"), int(NULL_ID)).to_numpy(), segmenter.units(data, offsets)))
            size += len(held[-1][1].start) + part.num_rows
            if size >= most:
                yield from flush()
                size = 0
    if held:
        yield from flush()


@tidy
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for used, own in zip(batch.column("used"), batch.column("total"), strict=True):
            used, own = np.frombuffer(used.as_buffer(), np.int64), np.frombuffer(own.as_buffer(), np.int64)
            total = np.pad(total, (0, max(0, int(used.max(initial=-1)) + 1 - len(total))))
            total[used] += own
    ids = np.flatnonzero(total)
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])


@tidy
def _write(folder: str, kind: str, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    ids, counts, values, size, number = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        nonlocal number
        path = f"{base}/part-{uuid.uuid4().hex}.bin"
        keys, n = np.concatenate(ids), np.concatenate(counts)
        write_file(fs, path, keys, n, np.frombuffer(b"".join(values), kind))
        row = [path[len(base) + 1 :], part, number, int(keys[0]), len(keys), int(n.sum())]
        number += 1
        for x in (ids, counts, values):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.int64()) for x in row[1:])], names=["file", "part", "number", "first_id", "n_docs", "n_tokens"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            ids.append(rows.column("doc_id").to_numpy())
            counts.append(rows.column("n").to_numpy())
            values += rows.column("ranks").to_pylist()
            size += sum(map(len, values[-rows.num_rows :]))
            if size >= file_bytes:
                yield flush()
                size = 0
    if ids:
        yield flush()


@tidy
def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    ids_of_rank = mapped(fs, f"{base}/ranks.bin", "<u4")
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            ids, counts, ranks = read_file(fs, f"{base}/{name}")
            tokens = np.asarray(ids_of_rank)[ranks].astype("<u4")
            stops = np.cumsum(counts, dtype=np.int64)
            begins = stops - counts
            held = memoryview(tokens.tobytes())
            for at in range(0, len(ids), 5000):
                rows = slice(at, at + 5000)
                blobs = [held[4 * a : 4 * b] for a, b in zip(begins[rows], stops[rows], strict=True)]
                keys = pa.array(ids[rows], pa.int64(), mask=ids[rows] == NULL_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins[rows] + start, pa.int64()), pa.array(counts[rows].astype(np.int64)), pa.array([bytes(x) for x in blobs], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, *, looked_up: int = LOOKED_UP, sent: int = GATHERED, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs' token files and ranks.bin to folder; the manifest: file, part, number, first_id, n_docs, n_tokens, start (ids before it), in order of doc_id."""
    spark = docs.sparkSession
    on_workers(spark)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    units = units_for(tokenizer_path)
    table, totals = build(source, lambda: units_for(tokenizer_path), folder, units.kind, gathered=sent)
    n = buckets(docs)
    # as many rows as the vocabulary has ids, whatever the corpus
    counts = totals.coalesce(max(1, min(n, 64))).mapInArrow(_add_up, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(max(units.size, end_id + 1), np.int64)
    for x in counts:
        held[x.id] = x.n
    place = F.coalesce(source["doc_id"], F.lit(int(NULL_ID)))
    n_docs, bounds = source.agg(F.count(F.lit(1)), F.percentile_approx(place, [k / n for k in range(1, n)] or [0.5], F.lit(max(10_000, 4 * n)))).first()
    held[end_id] += n_docs
    ids_of_rank = np.argsort(-held, kind="stable").astype("<u4")
    rank = np.empty(len(held), np.uint32)
    rank[ids_of_rank] = np.arange(len(held))
    fs, base = file_system(folder)
    with fs.open_output_stream(f"{base}/ranks.bin") as f:
        f.write(ids_of_rank.tobytes())
    bounds = np.array((bounds if n > 1 else None) or [], np.int64)
    shared = spark.sparkContext.broadcast((table, rank, end_id, bounds))
    encoded = source.mapInArrow(lambda b: _encode(tokenizer_path, shared, looked_up, b), "part int, doc_id long, n long, ranks binary")
    ordered = encoded.repartitionById(n, "part").sortWithinPartitions("part", "doc_id")
    kind = "<u2" if len(held) <= 1 << 16 else "<u4"
    files = cut(ordered.mapInArrow(lambda b: _write(folder, kind, file_bytes, b), "file string, part long, number long, first_id long, n_docs long, n_tokens long"))
    for name in table.names:
        if name:
            for end in ("key", "first", "value", "at", "bytes"):
                fs.delete_file(f"{base}/{name}.{end}")
    return _with_starts(files)


def _with_starts(files: DataFrame) -> DataFrame:
    """Ids before each file. The manifest has one row per file of megabytes."""
    return files.withColumn("start", F.sum("n_tokens").over(Window.orderBy("part", "number")) - F.col("n_tokens"))


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    on_workers(spark)
    spread = manifest.select("file", "start").repartition(buckets(manifest), "file")
    return spread.mapInArrow(lambda b: _read(folder, b), "doc_id long, start long, n_tokens long, ids binary")


@tidy
def _checksums(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(folder, batches):
        sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, **limits) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from files, which are deleted again."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    manifest = write(docs, folder, tokenizer_path, end_id, **limits)
    spread = manifest.select("file", "start").repartition(buckets(docs), "file")
    out = cut(spread.mapInArrow(lambda b: _checksums(folder, b), "doc_id long, start long, n_tokens long, ids_crc32 long"))
    drop_folder(spark, folder)
    return out
