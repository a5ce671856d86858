"""Interpolated modified Kneser-Ney model of order 3 (or 2): counted in Spark, kept as sorted hash arrays.

1. Words are counted (each task sends the distinct words it sees), and every range of word hashes is
   written as a sorted array with its counts; a word's number is its place over all ranges.
2. Grams are counted in several passes over the text, each for a part of the buckets, so that the exchange of one
   pass is all that lies on disk beside the model. Buckets hold pairs of word numbers, dealt out by a hash of the
   pair (a bijection), so a frequent word's pairs lie in all of them. Of order 3 a bucket gets, for each of its
   pairs, the words that follow with counts, and the distinct words that stand before (the pair's own,
   continuation, count); of order 2 the pair's count. It writes sorted arrays, and sends what its pairs add to each
   word: how often it is followed, by how many words once, twice, more often, and how many words it follows.
3. Those sums are written beside the words. Discounts come from the counts of counts of each order.

A pair's key takes five bytes (a directory over its highest bits replaces the rest), a trigram four bytes (its
last word, sorted within its pair) and counts of one a bit; other counts are listed apart.

Workers map the arrays into memory and look up each text's words, pairs and trigrams in sorted order. The model
covers all training rows; nothing is pruned.

Defined results: a null or empty text is only the end token. A null doc_id counts as the text ''. With no
training rows every token has the same probability. Repeated rows and ids count again. A text of any length is
turned into arrays as a whole. An empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_LOWER, U64, blob_of, buckets, cut, drop_folder, file_system, groups, in_parts, make_folder, mapped, mix, narrow, new_folder, on_workers, pieces, release, scale, tidy, wide, words_of
from .unit_table import distinct

#: Tokens that a task gathers before it counts, or looks up, what it has.
GATHERED = 1_500_000
#: Passes over the text in which trigrams are counted.
PASSES = 4
BEGIN, END = U64(0x0B0E0B0E0B0E0B0E), U64(0x0E0D0E0D0E0D0E0D)
_STATS = np.dtype([("total", "<u4"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4"), ("before", "<u4")])
_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "bucket int, keys binary, counts binary"
_GRAMS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("pairs", pa.binary()), ("others", pa.binary()), ("counts", pa.binary())])
_GRAMS_SQL = "bucket int, kind byte, pairs binary, others binary, counts binary"
_LOADED: dict[str, tuple] = {}


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 2**64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def _sorted_distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    at = groups(values)
    return values[at], np.diff(np.append(at, len(values)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = groups(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _deal(keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of sorted keys."""
    stops = np.searchsorted(scale(keys, n), np.arange(n + 1).astype(np.uint64))
    rows = [(k, blob_of(keys[a:b]), narrow(counts[a:b])) for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)) if b > a]
    yield from in_parts(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes with each text's end, where each text begins)."""
    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = words_of(data, offsets, SPACED_LOWER)
            hashes = words.hashes()
            n_docs = part.num_rows
            out = np.full(len(hashes) + n_docs, END, np.uint64)
            out[np.arange(len(hashes)) + words.owner()] = hashes
            yield part, out, words.first + np.arange(n_docs + 1)


@tidy
def _count_words(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for _, hashes, _ in _tokens(batches):
        held.append(hashes)
        size += len(hashes)
        if size >= GATHERED:
            yield from _deal(*_sorted_distinct(np.concatenate(held)), n)
            held, size = [], 0
    if held:
        yield from _deal(*_sorted_distinct(np.concatenate(held)), n)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A partition's buckets, each with its keys and their sums."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append((np.frombuffer(keys, np.uint64), wide(counts)))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        yield bucket, *_summed(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))


def _save(fs, path: str, values: np.ndarray) -> None:
    with fs.open_output_stream(path) as f:
        f.write(np.ascontiguousarray(values).tobytes())


@tidy
def _write_words(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    for bucket, keys, counts in _gathered(batches):
        name = f"words-{uuid.uuid4().hex}"
        _save(fs, f"{base}/{name}.key", keys)
        _save(fs, f"{base}/{name}.count", counts.astype("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), *(pa.array([int(x)], pa.int64()) for x in (len(keys), counts.sum(), (counts > 0).sum()))], names=["bucket", "name", "n", "tokens", "types"])


@dataclass
class Words:
    """Where the sorted word hashes lie: file of each bucket ('' if none) and the number of its first word."""

    folder: str
    names: list[str]
    first: np.ndarray


def _open(folder: str, name: str, kind) -> np.ndarray:
    fs, base = file_system(folder)
    return mapped(fs, f"{base}/{name}", kind)


def _opened(words: Words) -> list[np.ndarray]:
    if words.folder not in _LOADED:
        _LOADED.clear()
        _LOADED[words.folder] = [_open(words.folder, f"{x}.key", np.uint64) if x else np.empty(0, np.uint64) for x in words.names]
    return _LOADED[words.folder]


def _numbers(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The number of each of some sorted distinct hashes, -1 for unknown words."""
    files, n = _opened(words), len(words.names)
    out = np.full(len(hashes), -1, np.int64)
    stops = np.searchsorted(scale(hashes, n), np.arange(n + 1).astype(np.uint64))
    for k in np.flatnonzero(np.diff(stops)):
        if len(files[k]):
            mine = hashes[stops[k] : stops[k + 1]]
            at = np.minimum(np.searchsorted(files[k], mine), len(files[k]) - 1)
            out[stops[k] : stops[k + 1]] = np.where(files[k][at] == mine, at + words.first[k], -1)
    return out


# ---- arrays in files ---------------------------------------------------------------------------


def save_arrays(fs, path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that says where each array lies, then the arrays."""
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = [x.dtype.str, at, len(x)]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8 + 7) + b"\n"
    with fs.open_output_stream(path) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for x in arrays.values():
            f.write(blob_of(x) + bytes(-x.nbytes % 8))


def load_arrays(fs, path: str) -> dict[str, np.ndarray]:
    held = np.asarray(mapped(fs, path, np.uint8)).view(np.ndarray)
    size = int(held[:8].view("<u8")[0])
    body = held[8 + size :]
    return {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in json.loads(held[8 : 8 + size].tobytes()).items()}


def counts_in_bytes(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; 255 and more are listed apart."""
    large = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": large.astype("<u8"), f"{name}_large": values[large].astype("<u8")}


def counts_at(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[name][at].astype(np.int64)
    many = np.flatnonzero(out == 255)
    if len(many):
        out[many] = arrays[f"{name}_large"][np.searchsorted(arrays[f"{name}_at"], at[many].astype(np.uint64))]
    return out


def mostly_one(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of which most are one: a bit for each that isn't, how many such bits stand before each word of 64, and those counts in order."""
    other = values != 1
    bits = np.zeros(-(-(len(values) + 1) // 64) * 64, np.uint8)
    bits[: len(values)] = other
    words = np.packbits(bits, bitorder="little").view("<u8")
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    return {f"{name}_bits": words, f"{name}_before": before.astype("<u4" if len(values) < 1 << 32 else "<u8"), **counts_in_bytes(name, values[other])}


def mostly_one_at(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    held = arrays[f"{name}_bits"][word]
    out = np.ones(len(at), np.int64)
    other = np.flatnonzero(held >> bit & U64(1))
    rank = arrays[f"{name}_before"][word[other]].astype(np.int64) + np.bitwise_count(held[other] & ((U64(1) << bit[other]) - U64(1)))
    out[other] = counts_at(arrays, name, rank)
    return out


def _base(bucket: int, n: int) -> int:
    """The smallest hash of a bucket."""
    return -(-(bucket << 32) // n) << 32


def coded_keys(keys: np.ndarray, bucket: int, n: int) -> dict[str, np.ndarray]:
    """Sorted hashes of a bucket in five or six bytes each, and where each value of their bits above begins (about four keys each)."""
    rest = keys - U64(_base(bucket, n))
    largest = 2**64 // n + (1 << 32)
    kept = max(40, largest.bit_length() - max(0, (len(keys) // 4).bit_length()))
    below = kept - 32
    begins = np.searchsorted(rest >> U64(kept) if kept < 64 else np.zeros(len(rest), np.uint64), np.arange((largest >> kept) + 2).astype(np.uint64))
    return {
        "kept": np.array([kept], "<u8"), "directory": begins.astype("<u4" if len(keys) < 1 << 32 else "<u8"),
        "high": (rest >> U64(below) & U64(0xFFFFFFFF)).astype("<u4"), "low": (rest & U64((1 << below) - 1)).astype("<u1" if below <= 8 else "<u2" if below <= 16 else "<u4"),
    }


def _bisect(low: np.ndarray, high: np.ndarray, less) -> np.ndarray:
    """For each range the first place where less(place, which) is false."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        up = less(middle, open_)
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


def key_places(arrays: dict[str, np.ndarray], keys: np.ndarray, bucket: int, n: int) -> np.ndarray:
    """The place of each key in the bucket, -1 if it isn't there."""
    rest = keys - U64(_base(bucket, n))
    kept = int(arrays["kept"][0])
    h, l = arrays["high"], arrays["low"]  # noqa: E741
    slot = (rest >> U64(kept)).astype(np.int64) if kept < 64 else np.zeros(len(rest), np.int64)
    high, low = (rest >> U64(kept - 32) & U64(0xFFFFFFFF)).astype(np.uint32), (rest & U64((1 << kept - 32) - 1)).astype(l.dtype)

    def less(place: np.ndarray, which: np.ndarray) -> np.ndarray:
        there = h[place]
        return (there < high[which]) | ((there == high[which]) & (l[place] < low[which]))

    end = arrays["directory"][slot + 1].astype(np.int64)
    at = _bisect(arrays["directory"][slot].astype(np.int64), end, less)
    inside = np.minimum(at, max(len(h) - 1, 0))
    found = (at < end) & (h[inside] == high) & (l[inside] == low) if len(h) else np.zeros(len(at), bool)
    return np.where(found, at, -1)


# ---- grams -------------------------------------------------------------------------------------


def _before(values: np.ndarray, starts: np.ndarray, begin) -> np.ndarray:
    """Each token's predecessor's value; at the start of a text, begin."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = begin
    return out


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first << U64(32) | second)


def _runs(pairs: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, other) with counts, in no order of pairs."""
    codes, values = pd.factorize(pairs)
    both = np.sort(codes.astype(np.uint64) << U64(32) | others)
    at = groups(both)
    return values[(both[at] >> U64(32)).astype(np.int64)], (both[at] & U64(0xFFFFFFFF)).astype("<u4"), np.diff(np.append(at, len(both)))


@tidy
def _count_grams(words: Words, order: int, n: int, first: int, last: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs with the words that follow them and counts (order 2: pairs and counts); 1: pairs with the words before them. Only for buckets first to last - 1."""
    held, starts, size = [], [], 0

    def dealt(kind: int, pairs: np.ndarray, others: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = scale(pairs, n).astype(np.int64) - first
        by = np.argsort(bucket.astype(np.uint16) if last - first <= 1 << 16 else bucket, kind="stable")
        stops = np.searchsorted(bucket[by], np.arange(last - first + 1))
        rows = [(k, kind, blob_of(pairs[at]), blob_of(others[at]) if len(others) else b"", narrow(counts[at]) if len(counts) else b"") for k in np.flatnonzero(np.diff(stops)).tolist() for at in (by[stops[k] : stops[k + 1]],)]
        if rows:
            yield from in_parts(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GRAMS, strict=True)], schema=_GRAMS))

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        hashes, begins = np.concatenate(held), np.concatenate(starts)
        held.clear()
        starts.clear()
        size = 0
        codes, values, _ = distinct(np.append(hashes, BEGIN))
        order_ = np.argsort(values)
        number = np.empty(len(values), np.uint64)
        number[order_] = _numbers(words, values[order_]).astype(np.uint64)
        begin, own = number[codes[-1]], number[codes[:-1]]
        one = _before(own, begins, begin)
        pair = _pair(one, own)
        low, high = (U64(-(-(k << 32) // n)) for k in (first, last))
        mine = lambda p: np.flatnonzero(((p >> U64(32)) >= low) & ((p >> U64(32)) < high))
        at = mine(pair)
        if order == 2:
            keys, counts = _sorted_distinct(pair[at])
            yield from dealt(0, keys, np.empty(0, "<u4"), counts)
            return
        two = _before(one, begins, begin)
        before, many, _ = _runs(pair[at], two[at])
        yield from dealt(1, before, many, np.empty(0, np.int64))
        context = _before(pair, begins, _pair(np.array([begin]), np.array([begin]))[0])
        at = mine(context)
        yield from dealt(0, *_runs(context[at], own[at]))

    for _, hashes, begin in _tokens(batches):
        held.append(hashes)
        starts.append(begin[:-1] + size)
        size += len(hashes)
        if size >= most:
            yield from flush()
    if held:
        yield from flush()


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order by first, then second: only rows with an equal first are sorted twice."""
    by = np.argsort(first)
    held = first[by]
    equal = np.zeros(len(by), bool)
    equal[1:] = held[1:] == held[:-1]
    run = np.cumsum(~equal)
    equal[:-1] |= equal[1:]
    at = np.flatnonzero(equal)
    again = by[at]
    by[at] = again[np.argsort(run[at].astype(np.uint64) << U64(32) | second[again])]
    return by


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def _added(keys: np.ndarray, value: np.ndarray, first: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """By bucket of words, what a bucket's pairs (with counts) add to their words: numbers and the fields of _STATS."""
    keys, value = keys[value > 0], value[value > 0]
    both = unmix(keys)
    before, after = (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(before.astype(np.uint32), kind="stable")
    at, c = groups(before[order]), value[order]
    one = before[order][at]
    follow, n_follow = _sorted_distinct(after)
    every, _ = _sorted_distinct(np.concatenate([one, follow]))
    stats = {f: np.zeros(len(every), np.int64) for f in _STATS.names}
    place = np.searchsorted(every, one)
    if len(at):
        for field, values in (("total", c), ("one", c == 1), ("two", c == 2), ("more", c > 2)):
            stats[field][place] = np.add.reduceat(values.astype(np.int64), at)
    stats["before"][np.searchsorted(every, follow)] = n_follow
    stops = np.searchsorted(every, first)
    rows = []
    for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        if b > a:
            # the fields one after the other: most are small, and so easy to compress
            rows.append((k, narrow(np.diff(every[a:b] - first[k], prepend=0)), b"".join(len(x := narrow(stats[f][a:b])).to_bytes(4, "little") + x for f in _STATS.names)))
    return rows


@tidy
def _write_grams(folder: str, words_first: np.ndarray, order: int, n: int, first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's file, its counts of counts, and by bucket of words what its pairs add to each."""
    fs, base = file_system(folder)
    held: dict[int, dict[int, list[tuple]]] = {}
    for batch in batches:
        for bucket, kind, pairs, others, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, {0: [], 1: []})[kind].append((np.frombuffer(pairs, np.uint64), np.frombuffer(others, "<u4"), wide(counts) if counts else np.empty(0, np.int64)))
    names = ["bucket", "name", "of_grams", "of_pairs", "numbers", "stats"]
    for bucket in sorted(held):
        kinds = held.pop(bucket)
        pairs, others, counts = (np.concatenate([np.empty(0, t), *(x[k] for x in kinds[0])]) for k, t in enumerate((np.uint64, "<u4", np.int64)))
        name, number = f"grams-{uuid.uuid4().hex}", bucket + first
        arrays, of_grams = {}, [0] * 4
        if order == 2:
            keys, value = _summed(pairs, counts)
        else:
            by = _order(pairs, others)
            pairs, others, counts = pairs[by], others[by], counts[by]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]) | (others[1:] != others[:-1])
            at = np.flatnonzero(new)
            counts = np.add.reduceat(counts, at) if len(at) else counts
            pairs, others = pairs[at], others[at]
            of_grams = _of_counts(counts)
            begins = groups(pairs)
            before, words = (np.concatenate([np.empty(0, t), *(x[k] for x in kinds[1])]) for k, t in enumerate((np.uint64, "<u4")))
            kinds.clear()
            by = _order(before, words)
            before, words = before[by], words[by]
            new = np.ones(len(before), bool)
            new[1:] = (before[1:] != before[:-1]) | (words[1:] != words[:-1])
            before = before[new]  # a row for each distinct word before
            at = groups(before)
            known, value_of = before[at], np.diff(np.append(at, len(before)))
            keys, _ = _sorted_distinct(np.concatenate([pairs[begins], known]))
            value, followers = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            value[np.searchsorted(keys, known)] = value_of
            own = np.searchsorted(keys, pairs[begins])
            followers[own] = np.diff(np.append(begins, len(pairs)))
            sums = {k: np.zeros(len(keys), np.int64) for k in ("total", "one", "two")}
            if len(begins):
                for k, x in (("total", counts), ("one", counts == 1), ("two", counts == 2)):
                    sums[k][own] = np.add.reduceat(x.astype(np.int64), begins)
            # most pairs are followed by one word: the others are listed
            listed = np.flatnonzero(followers != 1)
            begin = (np.cumsum(followers) - followers)[np.append(listed, len(keys))[: len(listed)]] - listed if len(listed) else listed
            extra = np.append(begin, len(others) - len(keys))  # rows before a pair beyond one for each pair before
            arrays = {"listed": listed.astype("<u4" if len(keys) < 1 << 32 else "<u8"), "extra": extra.astype("<i8" if len(others) >= 1 << 31 else "<i4"), **counts_in_bytes("followers", followers[listed]), "last": others}
            for k, x in sums.items():
                arrays |= counts_in_bytes(k, x[listed])
            arrays |= mostly_one("count", counts)
        save_arrays(fs, f"{base}/{name}", {**coded_keys(keys, number, n), **mostly_one("value", value), **arrays})
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), *(pa.array([x], pa.list_(pa.int64())) for x in (of_grams, _of_counts(value))), none, none], names=names)
        rows = _added(keys, value, words_first)
        if rows:
            empty = pa.nulls(len(rows), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.nulls(len(rows), pa.string()), empty, empty, pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], names=names)


@tidy
def _write_stats(folder: str, words: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, numbers, stats in zip(*(batch.column(c).to_pylist() for c in ("bucket", "numbers", "stats")), strict=True):
            if bucket not in sums:
                sums[bucket] = np.zeros((len(_STATS.names), int(words.first[bucket + 1] - words.first[bucket])), np.int64)
            place, at = np.cumsum(wide(numbers)), 0
            for row in range(len(_STATS.names)):
                size = int.from_bytes(stats[at : at + 4], "little")
                sums[bucket][row, place] += wide(stats[at + 4 : at + 4 + size])
                at += 4 + size
    for bucket, rows in sums.items():
        name = f"stats-{uuid.uuid4().hex}"
        out = np.zeros(rows.shape[1], _STATS)
        for field, values in zip(_STATS.names, rows, strict=True):
            out[field] = values
        _save(fs, f"{base}/{name}", out)
        before = rows[-1]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([int(before.sum())], pa.int64()), pa.array([[int((before == k).sum()) for k in range(1, 5)] + [int((before > 2).sum())]], pa.list_(pa.int64()))], names=["bucket", "name", "total", "of_counts"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts 0, 1, 2 and more give up."""
    if not n1:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    out = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(out[1:], 1))])


@dataclass
class Model:
    """A folder of arrays and the few numbers that hold for all of them."""

    order: int
    words: Words
    gram_names: list[str]
    stat_names: list[str]
    tokens: int
    types: int
    gram_discounts: np.ndarray
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_total: int
    word_rest: float

    def word_values(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes: number (-1: unknown), training count, lower-order probability, times followed, mass left to the lower order."""
        numbers = _numbers(self.words, hashes)
        count, followed, left = np.zeros(len(hashes), np.int64), np.zeros(len(hashes)), np.zeros(len(hashes))
        lower = np.full(len(hashes), self.word_rest)
        bucket = np.searchsorted(self.words.first, numbers, side="right") - 1
        for k in np.unique(bucket[numbers >= 0]):
            mine = np.flatnonzero((bucket == k) & (numbers >= 0))
            at = numbers[mine] - self.words.first[k]
            count[mine] = _open(self.words.folder, f"{self.words.names[k]}.count", "<u8")[at]
            if not self.stat_names[k]:
                continue
            stats = _open(self.words.folder, self.stat_names[k], _STATS)[at]
            before = stats["before"].astype(np.int64)
            if self.word_total:
                lower[mine] += np.maximum(before - self.word_discounts[np.minimum(before, 3)], 0) / self.word_total
            followed[mine] = stats["total"]
            left[mine] = stats["one"] * self.pair_discounts[1] + stats["two"] * self.pair_discounts[2] + stats["more"] * self.pair_discounts[3]
        return numbers, count, lower, followed, left

    def gram_values(self, keys: np.ndarray, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """For distinct sorted pairs their counts; for rows of (place of the context in keys, number of the last word): the trigram's count, and the context's total and mass left to the lower order."""
        n = len(self.gram_names)
        value = np.zeros(len(keys), np.int64)
        count, total, left = np.zeros(len(context), np.int64), np.zeros(len(context)), np.zeros(len(context))
        stops = np.searchsorted(scale(keys, n), np.arange(n + 1).astype(np.uint64))
        rows_by = np.argsort(context.astype(np.int32) if len(keys) < 1 << 31 else context)
        row_stops = np.searchsorted(context[rows_by], stops)
        fs, base = file_system(self.words.folder)
        for k in np.flatnonzero(np.diff(stops)):
            if not self.gram_names[k]:
                continue
            arrays = load_arrays(fs, f"{base}/{self.gram_names[k]}")
            place = key_places(arrays, keys[stops[k] : stops[k + 1]], int(k), n)
            known = np.flatnonzero(place >= 0)
            value[stops[k] + known] = mostly_one_at(arrays, "value", place[known])
            if self.order == 2:
                continue
            rows = rows_by[row_stops[k] : row_stops[k + 1]]
            here = place[context[rows] - stops[k]]
            rows, here = rows[here >= 0], here[here >= 0]
            listed = arrays["listed"]
            at = np.searchsorted(listed, here)
            special = (at < len(listed)) & (listed[np.minimum(at, max(len(listed) - 1, 0))] == here) if len(listed) else np.zeros(len(here), bool)
            begin = here + arrays["extra"][at].astype(np.int64)
            followers, sums = np.ones(len(here), np.int64), {x: np.zeros(len(here), np.int64) for x in ("total", "one", "two")}
            followers[special] = counts_at(arrays, "followers", at[special])
            for x in sums:
                sums[x][special] = counts_at(arrays, x, at[special])
            single = np.flatnonzero(~special)
            only = mostly_one_at(arrays, "count", begin[single])
            sums["total"][single], sums["one"][single], sums["two"][single] = only, only == 1, only == 2
            wanted = last[rows]
            end = begin + followers
            spot = _bisect(begin, end, lambda p, which, a=arrays["last"], w=wanted: a[p] < w[which])
            hit = np.flatnonzero((spot < end) & (arrays["last"][np.minimum(spot, max(len(arrays["last"]) - 1, 0))] == wanted)) if len(arrays["last"]) else np.empty(0, np.int64)
            count[rows[hit]] = mostly_one_at(arrays, "count", spot[hit])
            total[rows] = sums["total"]
            d = self.gram_discounts
            left[rows] = sums["one"] * d[1] + sums["two"] * d[2] + (followers - sums["one"] - sums["two"]) * d[3]
        return value, count, total, left


def train(docs: DataFrame, folder: str, order: int = 3, *, passes: int = PASSES, gathered: int = GATHERED) -> Model:
    """Counts docs' texts into a model of order 2 or 3 in folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    on_workers(spark)
    n = buckets(docs)
    n_words = max(1, n // 4)
    make_folder(spark, folder)
    text = docs.select(docs["text"].alias("text"))
    begin = spark.createDataFrame([(int(scale(np.array([BEGIN]), n_words)[0]), bytearray(int(BEGIN).to_bytes(8, "little")), bytearray(b"\x01\x00"))], _SENT_SQL)
    sent = text.mapInArrow(lambda b: _count_words(n_words, b), _SENT_SQL).union(begin).repartitionById(n_words, "bucket")
    # the lists of files have one row per bucket, that is per megabytes of input
    files = cut(sent.mapInArrow(lambda b: _write_words(folder, b), "bucket int, name string, n long, tokens long, types long")).collect()
    names, sizes = [""] * n_words, np.zeros(n_words, np.int64)
    for row in files:
        names[row.bucket], sizes[row.bucket] = row.name, row.n
    words = Words(folder, names, np.append(0, np.cumsum(sizes)))
    if words.first[-1] >= 1 << 32:
        raise ValueError("more distinct words than 32-bit numbers")
    shared = spark.sparkContext.broadcast(words)
    gram_names, of_grams, of_pairs, parts = [""] * n, np.zeros(4, np.int64), np.zeros(4, np.int64), []
    edges = sorted({k * n // passes for k in range(passes + 1)}) if order == 3 else [0, n]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        grams = text.mapInArrow(lambda b, x=(first, last): _count_grams(shared.value, order, n, *x, gathered, b), _GRAMS_SQL).repartitionById(last - first, "bucket")
        written = grams.mapInArrow(lambda b, x=first: _write_grams(folder, shared.value.first, order, n, x, b), "bucket int, name string, of_grams array<long>, of_pairs array<long>, numbers binary, stats binary")
        written = cut(written)
        del grams
        release(spark)
        for row in written.filter("name IS NOT NULL").select("bucket", "name", "of_grams", "of_pairs").collect():
            gram_names[row.bucket] = row["name"]
            of_grams += np.array(row.of_grams)
            of_pairs += np.array(row.of_pairs)
        parts.append(written.filter("name IS NULL").select("bucket", "numbers", "stats"))
    sums = parts[0]
    for more in parts[1:]:
        sums = sums.union(more)
    sums = sums.repartitionById(n_words, "bucket")
    stat_names, of_words, total = [""] * n_words, np.zeros(5, np.int64), 0
    for row in cut(sums.mapInArrow(lambda b: _write_stats(folder, shared.value, b), "bucket int, name string, total long, of_counts array<long>")).collect():
        stat_names[row.bucket] = row["name"]
        of_words += np.array(row.of_counts)
        total += row.total
    tokens, types = sum(x.tokens for x in files), sum(x.types for x in files)
    lower = discounts(*(int(x) for x in of_words[:4]))
    given_up = lower[1] * of_words[0] + lower[2] * of_words[1] + lower[3] * of_words[4]
    rest = (given_up / total if total else 1.0) / (types + 1)
    return Model(order, words, gram_names, stat_names, tokens, types, discounts(*(int(x) for x in of_grams)), discounts(*(int(x) for x in of_pairs)), lower, total, float(rest))


@tidy
def _score(model: Model, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        hashes = np.concatenate([x[1] for x in held])
        shift = np.append(0, np.cumsum([len(x[1]) for x in held]))
        first = np.concatenate([*(x[2][:-1] + s for x, s in zip(held, shift, strict=False)), shift[-1:]])
        starts = first[:-1]
        codes, values, _ = distinct(np.append(hashes, BEGIN))
        by = np.argsort(values)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        own, begin = place[codes[:-1]], place[codes[-1]]
        numbers, count, lower, followed, left = model.word_values(values[by])
        base = np.log10((count + 1.0) / (model.tokens + model.types + 1.0))[own]
        before = _before(own, starts, begin)
        number = np.maximum(numbers, 0).astype(np.uint64)
        known = (numbers[own] >= 0) & (numbers[before] >= 0)
        # the places of pairs among the distinct ones in order, -1 for those with unknown words; a context is the pair before
        pair, known = np.append(_pair(number[before], number[own]), _pair(number[[begin]], number[[begin]])), np.append(known, numbers[begin] >= 0)
        codes, keys = pd.factorize(pair[known])
        by = np.argsort(keys)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        keys, spot = keys[by], np.full(len(pair), -1, np.int64)
        spot[known] = rank[codes]
        context, spot = _before(spot[:-1], starts, spot[-1]), spot[:-1]
        rows, known = np.flatnonzero(context >= 0), known[:-1]
        last = np.where(numbers[own[rows]] >= 0, number[own[rows]], U64(0xFFFFFFFF)).astype(np.uint32)  # no word has that number
        value, gram, total, gram_left = model.gram_values(keys, context[rows], last)
        c = np.zeros(len(own), np.int64)
        c[known] = value[spot[known]]
        p = lower[own]
        seen = np.flatnonzero(followed[before] > 0)
        v, c = before[seen], c[seen]
        p[seen] = (np.maximum(c - model.pair_discounts[np.minimum(c, 3)], 0) + left[v] * p[seen]) / followed[v]
        if model.order == 3:
            full = np.flatnonzero(total > 0)
            c, at = gram[full], rows[full]
            p[at] = (np.maximum(c - model.gram_discounts[np.minimum(c, 3)], 0) + gram_left[full] * p[at]) / total[full]
        log_p = np.log10(p)
        n_known = np.add.reduceat((count > 0).astype(np.int64)[own], starts)
        columns = [np.diff(first), n_known, np.add.reduceat(base, starts), np.add.reduceat(log_p, starts)]
        at = 0
        for part, _, begins in held:
            mine = slice(at, at + len(begins) - 1)
            at = mine.stop
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(x[mine]) for x in columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        held.clear()
        size = 0

    for part, hashes, first in _tokens(batches):
        held.append((part.select(["doc_id", "held_out"]), hashes, first))
        size += len(hashes)
        if size >= most:
            yield from flush()
    if held:
        yield from flush()


def score(docs: DataFrame, model: Model, held_out=None, *, gathered: int = GATHERED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score (add-one unigram) and score, both sums of log10."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), docs["text"].alias("text"))
    return source.mapInArrow(lambda b: _score(shared.value, gathered, b), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 3, *, passes: int = PASSES, gathered: int = GATHERED) -> DataFrame:
    """Scores every document by a model of those whose crc32(doc_id as text) mod folds isn't held; adds train_tokens and perplexity."""
    spark: SparkSession = docs.sparkSession
    held_out = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % folds == held
    folder = new_folder(spark, "model")
    model = train(docs.filter(~held_out), folder, order, passes=passes, gathered=gathered)
    out = score(docs, model, held_out, gathered=gathered).withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
    out = cut(out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
    drop_folder(spark, folder)
    return out
