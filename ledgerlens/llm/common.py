"""Shared pieces of the corpus operators: vectorised words, checkpoints, exchange by number."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_LIBC = None
with contextlib.suppress(OSError):
    _LIBC = ctypes.CDLL(None)
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SEED = np.random.Generator(np.random.PCG64(20240229))
#: Hashes are polynomials modulo this prime, in a fixed base drawn at random: two sequences of n parts have one hash
#: with a chance of n / PRIME.
PRIME = (1 << 61) - 1
WORD_BASE, WINDOW_BASE = (int(x) for x in _SEED.integers(1 << 59, PRIME, 2))
_POWERS: dict[int, np.ndarray] = {}
#: Longer words are hashed one by one, by blake2.
LONG_WORD = 63
#: Bytes of text that are turned into arrays at a time (the arrays take about 20 times as much).
PIECE_BYTES = 2 << 20


# ---- session -----------------------------------------------------------------------------------


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver's sys.path has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one is set only where none is and all runs on one machine."""
    on_workers(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    holder = spark.sparkContext._jsc.sc()
    if holder.getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named or holder.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into reliable checkpoint files; what it was made from can be freed."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle and checkpoint files that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ledgerlens-{what}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def buckets(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Exchange width: the session's shuffle partitions, more where the input is larger: up to 20,000 of bytes_each, beyond that of more, 16 times as many bytes at most."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        size = 0
    size = 0 if size > 1 << 60 else size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(size / bytes_each), max(20_000, math.ceil(size / bytes_each / 16))))


def file_system(uri: str):
    """(file system, path) for a folder of shared_dir; any store that pyarrow knows."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def mapped(fs, path: str, kind) -> np.ndarray:
    """A read-only array over a file: memory-mapped where the store is a file system."""
    import pyarrow.fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype=kind)


# ---- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits: 2^61 counts as 1."""
    low = U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31)) + reduced(a0 * b0))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo PRIME."""
    held = _POWERS.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, times(held, U64(pow(base, len(held), PRIME)))])
    if len(held) <= 1 << 22:  # a very long text's are not kept
        _POWERS[base] = held
    return held[:n]


def scale(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers 0..n-1 from the high halves of 64-bit hashes."""
    return ((h >> U64(32)) * U64(n)) >> U64(32)


# ---- words -------------------------------------------------------------------------------------


def _table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[list(separators)] = False
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    return word, to


SPACED = _table(SPACE_BYTES, False)
SPACED_LOWER = _table(SPACE_BYTES, True)
#: Lower-cased runs of digits, a-z and everything beyond ASCII.
ALNUM_LOWER = _table(bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122)), True)


@dataclass
class Words:
    """The words of some texts: text k has words first[k]:first[k + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word: a polynomial over its length and its lanes of seven bytes."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(self.data) + 1,), (1,))
        length = self.end - self.start
        h = _LENGTHS[np.minimum(length, LONG_WORD + 1)] + (eights[self.start] & _LANES[np.minimum(length, 7)])
        h = np.where(h >= U64(PRIME), h - U64(PRIME), h)
        more, at = np.flatnonzero((length > 7) & (length <= LONG_WORD)), 7
        while len(more):
            h[more] = reduced(times(h[more], U64(WORD_BASE)) + (eights[self.start[more] + at] & _LANES[np.minimum(length[more] - at, 7)]))
            at += 7
            more = more[length[more] > at]
        for k in np.flatnonzero(length > LONG_WORD).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "little") % PRIME
        return mix(h)


_LANES = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
_LENGTHS = np.array([k * WORD_BASE % PRIME for k in range(LONG_WORD + 2)], np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, how=SPACED) -> Words:
    """Words of texts that lie end to end in data; a word never spans two texts."""
    is_word, to = how
    data = to[data]
    n = len(data)
    inside = is_word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | begins[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large strings in one array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large string array, offsets from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits a batch between rows into parts of about limit bytes of text (a longer text stays whole)."""
    if not batch.num_rows:
        return
    text = as_text(batch.column(batch.schema.get_field_index(column)))
    data, offsets = raw(text)
    row = 0
    while row < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), batch.num_rows)
        yield batch.slice(row, to - row), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def in_parts(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes, so that what goes to the JVM at a time is small."""
    rows = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def blob_of(parts: np.ndarray) -> bytes:
    return np.ascontiguousarray(parts).tobytes()


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte says how many."""
    size = 1 if counts.max(initial=0) < 256 else 2 if counts.max() < 65536 else 4 if counts.max() < 1 << 32 else 8
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def number_of(column: pa.Array, kind) -> np.ndarray:
    """The numbers in a binary column's rows, end to end."""
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid)])


def tidy(run):
    """For functions of a task's batches (the last argument): gives memory back that the task has freed, as a worker goes on to other tasks."""

    @functools.wraps(run)
    def tidied(*arguments):
        try:
            yield from run(*arguments)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]]))
