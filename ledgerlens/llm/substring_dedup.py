"""Removal of word windows that repeat across documents.

Every window of `width` consecutive words has a Rabin-Karp style 64-bit hash. Windows are counted in
Spark: they are dealt out by hash in blobs of numbers (seven bytes of hash and one or two of place per
window), and where a window's hash starts in several documents, every document but the one with the
smallest id loses the words it covers; overlapping windows merge into maximal intervals. Before the
exchange each task settles the repeats it sees itself and passes on the smallest document only, so a
window that stands in a third of all documents costs each task one entry.

Windows are judged on the input, not on what is left. Hashes are polynomials modulo a prime of 61 bits, of words
hashed alike, and at least 60 bits decide: of a trillion windows some hundred thousand would collide.

Defined results: a null or empty text has no words. A text of any length is turned into arrays as a whole. Rows with a null doc_id are kept whole and remove
nothing elsewhere. Rows that share a doc_id count as one document. Texts of fewer than `width` words
are kept whole. An empty table gives an empty result; extra columns, whatever their
names, are kept by `deduplicate`. Of equal windows in several documents the one in the smallest doc_id stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, U64, WINDOW_BASE, as_text, blob_of, buckets, cut, groups, ids_of, in_parts, mix, on_workers, pieces, powers, reduced, scale, tidy, times, words_of

#: Windows that a task gathers before it settles its own repeats (about 100 bytes each for that time).
GATHERED = 1_500_000
_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("steps", pa.binary())])
_MESSAGE_SQL = "bucket int, kind byte, ids binary, prints binary, counts binary, hashes binary, steps binary"
_PACKED = pa.schema([("target", pa.int32()), ("ids", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_PACKED_SQL = "target int, ids binary, prints binary, counts binary, places binary"
_FOUND_SQL = "doc_id long, print long, places binary"


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 63-bit hash for each place where width words follow: differences of prefix sums of a polynomial modulo PRIME."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    terms = times(reduced(words), powers(WINDOW_BASE, len(words)))
    # sums of halves don't overflow, and those of one window are short
    low, high = np.zeros(len(words) + 1, np.uint64), np.zeros(len(words) + 1, np.uint64)
    np.cumsum(terms & U64((1 << 32) - 1), out=low[1:])
    np.cumsum(terms >> U64(32), out=high[1:])
    low, high = low[width:] - low[:-width], high[width:] - high[:-width]
    sums = reduced((high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32)) + reduced(low))
    return mix(times(sums, powers(pow(WINDOW_BASE, -1, PRIME), n))) >> U64(1)


def _settle(hashes: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows start in a document that isn't the smallest of those with the same window."""
    order = np.argsort(hashes).astype(np.int32 if len(hashes) < 1 << 31 else np.int64)
    starts = groups(hashes[order])
    doc = ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(order)))) if len(order) else doc
    later = np.empty(len(order), bool)
    later[order] = doc > least
    return later


def _least(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need; the first byte says how many (9: signed)."""
    if len(values) and values.min() < 0:
        return b"\x09" + values.astype("<i8").tobytes()
    size = next(x for x in (1, 2, 4, 8) if x == 8 or values.max(initial=0) < 1 << (8 * x))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _most(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8" if blob[0] == 9 else f"<u{blob[0]}", offset=1).astype(np.int64)


def _packed(owner: np.ndarray, place: np.ndarray, ids: np.ndarray, prints: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Places to remove, one row for each bucket of documents."""
    target = scale(mix(ids.astype(np.uint64)), n).astype(np.int64)
    order = np.lexsort((owner, target[owner]))
    owner, place = owner[order], place[order]
    starts = groups(owner)
    docs, counts = owner[starts], np.diff(np.append(starts, len(owner)))
    edges = np.append(groups(target[docs]), len(docs))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        stop = starts[b] if b < len(starts) else len(place)
        rows.append((int(target[docs[a]]), _least(ids[docs[a:b]]), blob_of(prints[docs[a:b]]), _least(counts[a:b]), _least(place[starts[a] : stop].astype(np.int64))))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


@tidy
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its places, from a partition's packed rows."""
    held: list[tuple] = []
    for batch in batches:
        for ids, prints, counts, places in zip(*(batch.column(c).to_pylist() for c in ("ids", "prints", "counts", "places")), strict=True):
            held.append((np.repeat(_most(ids), counts := _most(counts)), np.repeat(np.frombuffer(prints, "<u4"), counts), _most(places)))
    if held:
        ids, prints, places = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((prints, ids))
        ids, prints, places = ids[order], prints[order].astype(np.int64), places[order].astype("<u4")
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
        edges = np.append(np.flatnonzero(new), len(ids))
        for at in range(0, len(edges) - 1, 1000):
            mine = edges[at : at + 1001]
            yield pa.RecordBatch.from_arrays([pa.array(ids[mine[:-1]]), pa.array(prints[mine[:-1]]), pa.array([blob_of(places[a:b]) for a, b in zip(mine[:-1], mine[1:], strict=True)], pa.binary())], names=["doc_id", "print", "places"])


def _emit(hashes: np.ndarray, offsets: np.ndarray, ids: np.ndarray, prints: np.ndarray, n: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket with the windows that are left, and one with what this task has settled."""
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
    later = _settle(hashes, owner, ids)
    rows: list[list] = [[] for _ in _MESSAGE]

    def add(*values) -> None:
        for row, value in zip(rows, values, strict=True):
            row.append(value)

    at = np.flatnonzero(later)
    if len(at):
        known = np.unique(owner[at])
        place = (at - offsets[owner[at]]).astype("<u4")
        ends = np.searchsorted(owner[at], known, side="right")
        add(seed % n, 1, _least(ids[known]), blob_of(prints[known]), _least(np.diff(ends, prepend=0)), b"", blob_of(place))
    left = np.flatnonzero(~later)
    bucket = scale(hashes[left] << U64(1), n).astype(np.uint16 if n <= 1 << 16 else np.uint32)
    by = np.argsort(bucket, kind="stable")
    left, bucket = left[by], bucket[by]
    del by, later
    stops = np.searchsorted(bucket, np.arange(n + 1))
    for k in range(n):
        mine = left[stops[k] : stops[k + 1]]
        if len(mine):
            used = np.unique(owner[mine])
            # windows are numbered anew over the documents that this row names
            first = np.append(0, np.cumsum(np.diff(offsets)[used]))
            to = first[np.searchsorted(used, owner[mine])] + mine - offsets[owner[mine]]
            step = np.diff(to, prepend=0)
            steps = b"\x00" + blob_of(step.astype(np.uint8)) if step.max() < 256 else b"\x01" + blob_of(step.astype("<u4"))
            part = (_least(ids[used]), blob_of(prints[used]), _least(np.diff(first)))
            # the high byte of the hash is mostly the bucket's number, the rest says more
            add(k, 0, *part, blob_of(hashes[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7] if n >= 32 else hashes[mine].astype("<u8")), steps)
    out = pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _MESSAGE, strict=True)], schema=_MESSAGE)
    yield from in_parts(out)


@tidy
def _hash_windows(width: int, n: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([x[0] for x in held])
        offsets = np.append(0, np.cumsum(np.concatenate([x[1] for x in held])))
        ids, prints = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        held.clear()
        return _emit(hashes, offsets, ids, prints, n, int(hashes[0] % U64(1 << 31)) if len(hashes) else 0)

    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = words_of(data, offsets)
            counts = np.maximum(words.counts() - width + 1, 0)
            if not counts.any():
                continue
            all_windows = window_hashes(words.hashes(), width)
            some = np.flatnonzero(counts)
            first = words.first[some]
            at = np.repeat(first - np.append(0, np.cumsum(counts[some])[:-1]), counts[some]) + np.arange(counts.sum())
            held.append((all_windows[at], counts[some], ids_of(part)[some], ids_of(part, "print")[some].astype("<u4")))
            gathered += len(at)
            if gathered >= most:
                yield from flush()
                gathered = 0
    if held:
        yield from flush()


@tidy
def _merge(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's buckets: the windows whose hash stands in a smaller document elsewhere."""
    kept: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            bucket, kind, ids, prints, counts, hashes, steps = (c[row] for c in batch.columns)
            ids, counts, prints = _most(ids.as_py()), _most(counts.as_py()), np.frombuffer(prints.as_buffer(), "<u4")
            if kind.as_py():
                yield from _packed(np.repeat(np.arange(len(ids)), counts), np.frombuffer(steps.as_buffer(), "<u4"), ids, prints, n)
                continue
            offsets, raw = np.append(0, np.cumsum(counts)), steps.as_py()
            window = np.cumsum(np.frombuffer(raw, np.uint8 if raw[0] == 0 else "<u4", offset=1), dtype=np.int64)
            given = np.frombuffer(hashes.as_buffer(), np.uint8).reshape(len(window), -1)
            if given.shape[1] == 7:
                wide = np.zeros((len(window), 8), np.uint8)
                wide[:, :7] = given
                given = wide
            owner = (np.searchsorted(offsets, window, side="right") - 1).astype(np.int32)
            kept.setdefault(bucket.as_py(), []).append((given.view("<u8").ravel(), owner, (window - offsets[owner]).astype(np.uint32), ids, prints))
    for parts in kept.values():
        shift = np.append(0, np.cumsum([len(x[3]) for x in parts]))
        hashes = np.concatenate([x[0] for x in parts])
        owner = np.concatenate([x[1] + s for x, s in zip(parts, shift, strict=False)])
        place = np.concatenate([x[2] for x in parts])
        ids, prints = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
        at = np.flatnonzero(_settle(hashes, owner, ids))
        if len(at):
            yield from _packed(owner[at], place[at], ids, prints, n)


def repeated_windows(docs: DataFrame, width: int = 50, *, gathered: int = GATHERED) -> DataFrame:
    """doc_id, print (a fingerprint of the text) and places: for each document with windows to remove, their starts (binary, unsigned 32-bit)."""
    on_workers(docs.sparkSession)
    n = buckets(docs)
    source = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).bitwiseAND(0xFFFFFFFF).alias("print"), docs["text"].alias("text"))
    sent = source.mapInArrow(lambda b: _hash_windows(width, n, gathered, b), _MESSAGE_SQL).repartitionById(n, "bucket")
    found = sent.mapInArrow(lambda b: _merge(n, b), _PACKED_SQL).repartitionById(n, "target")
    return cut(found.mapInArrow(_unpack, _FOUND_SQL))


def covered(places: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """True for each word inside a window that starts at one of places."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places.astype(np.int64) + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


@tidy
def _apply(width: int, keep: list[str], digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n_words, n_removed, texts = [], [], []
            for value, found in zip(as_text(part.column("_text")), part.column("_places"), strict=True):
                data = value.as_buffer().to_pybytes()
                words = data.split()
                removed = 0
                if found.is_valid:
                    gone = covered(np.frombuffer(found.as_buffer(), "<u4"), len(words), width)
                    removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    kept = b" ".join(words) if digests else data
                n_words.append(len(words))
                n_removed.append(removed)
                texts.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode())
            arrays = [pa.array(texts, pa.string()) if c == "text" else part.column(f"_{k}") for k, c in enumerate(keep)]
            names = list(keep)
            if digests:
                arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
                names += ["n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def deduplicate(docs: DataFrame, width: int = 50, *, digests: bool = False, gathered: int = GATHERED) -> DataFrame:
    """The rows of docs with repeated windows cut out of text (kept words of a changed text are joined by one space).

    With digests: doc_id, n_words, n_removed, kept_sha256 instead.
    """
    found = repeated_windows(docs, width, gathered=gathered).select(F.col("doc_id").alias("_found_id"), F.col("print").alias("_found_print"), F.col("places").alias("_places"))
    keep = ["doc_id"] if digests else docs.columns
    # own names inside: the documents' columns may have any
    source = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"), *(docs[c].alias(f"_{k}") for k, c in enumerate(keep) if c != "text"))
    # one row for each changed document, so the hashed side is small in every partition
    print_ = F.xxhash64("_text").bitwiseAND(0xFFFFFFFF)
    source = source.join(found.hint("shuffle_hash"), (F.col("_id") == F.col("_found_id")) & (print_ == F.col("_found_print")), "left").drop("_id", "_found_id", "_found_print")
    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + (["n_words long", "n_removed long", "kept_sha256 string"] if digests else [])
    return source.mapInArrow(lambda b: _apply(width, keep, digests, b), ", ".join(schema))
