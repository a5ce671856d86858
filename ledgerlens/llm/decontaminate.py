"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words become symbols (words no benchmark phrase has share
one), its suffixes are sorted, and the last column of that sort is kept as a wavelet matrix. All benchmark phrases (windows of `width` words; a shorter
item is one phrase) are sought at once, word by word from the end, by rank queries; the rows found are
walked back to sampled suffixes, which gives the places. Covered words merge into spans.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_WORDS words, so what a
worker holds is bounded; every document meets every block, and no document data is exchanged. Hits of
all blocks are sought in the text as it came and united row by row, so block sizes never change a result.

Defined results: null texts have no words; items without words are no phrase. Rows of one item_id are one
item; the windows of a row with a null item_id hit words but belong to no item. Documents with a null doc_id are treated like any other. Rows that share a doc_id
stay rows of their own. A text of any length is a shard of its own. An empty benchmark leaves every document
clean; an empty document table gives an empty result; extra columns, whatever their names, are kept by `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import ALNUM_LOWER, U64, as_text, on_workers, pieces, raw, tidy, words_of

#: Words of benchmark text that a worker looks up at once; larger benchmarks take several passes.
BLOCK_WORDS = 1_000_000
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Every so many-th place of the text is sampled.
SAMPLE = 8


@dataclass
class Phrases:
    """Distinct phrases of one block: symbols (0 ends a text, 1 is any other word) and the items that have them."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    item_first: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases_of(rows: list[tuple], width: int) -> Phrases:
    """Phrases of (item_id, text) rows."""
    texts = as_text(pa.array([x[1] for x in rows], pa.string()))
    words = words_of(*raw(texts), ALNUM_LOWER)
    counts = words.counts()
    vocabulary, symbol = np.unique(words.hashes(), return_inverse=True)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(rows)), many)
    place = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(counts, width)[item]
    padded = np.append(symbol.astype(np.int32) + 2, np.zeros(width, np.int32))
    symbols = padded[place[:, None] + np.arange(width)]
    symbols[np.arange(width) >= length[:, None]] = 0
    # rows of one item_id are one item; a row without an id has phrases, but is none
    names = sorted({str(x[0]) for x in rows if x[0] is not None})
    number = {name: k for k, name in enumerate(names)}
    named = np.array([-1 if x[0] is None else number[str(x[0])] for x in rows], np.int64)[item] if rows else item
    # one row for each distinct phrase, and its items in order
    _, at, phrase = np.unique(symbols.view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True)
    n = max(1, len(names))
    both = np.unique((phrase.astype(np.int64) * n + named)[named >= 0])
    first = np.searchsorted(both // n, np.arange(len(at) + 1))
    return Phrases(vocabulary, symbols[at], length[at], first, both % n, names)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit per level, with counts of ones before each word of 64 bits."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), max(1, int(top).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(np.uint64)) - U64(1)
        return self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbol, low, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = (self.bits[k][place >> 6] >> (place & 63).astype(np.uint64) & U64(1)).astype(bool)
            symbol = symbol << 1 | one
            a, b = self._ones(k, low), self._ones(k, place)
            low = np.where(one, self.zeros[k] + a, low - a)
            place = np.where(one, self.zeros[k] + b, place - b)
        return symbol, place - low


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """The suffix array of a text that ends with its only 0: one sort by some leading symbols, then doubling among what is still equal."""
    n, width = len(text), max(1, int(top).bit_length())
    ahead = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(min(ahead, n)):
        key[: n - k] |= text[k:] << (width * (ahead - 1 - k))
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)  # the first row of the equal ones
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    rows = np.flatnonzero(~alone)
    while len(rows):
        suffix = order[rows]
        one, two = rank[suffix], rank[suffix + ahead]
        by = np.lexsort((two, one))
        suffix, one, two = suffix[by], one[by], two[by]
        order[rows] = suffix
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        rank[suffix] = np.maximum.accumulate(np.where(new, rows, 0))
        rows = rows[~(new & np.append(new[1:], True))]
        ahead *= 2
    return order


class FMIndex:
    """Of a text of symbols up to top that ends with its only 0."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_order(text, top)
        last = text[order - 1]  # place 0 has the text's end before it
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        self.tree = WaveletMatrix(last, top)
        self.sampled = order % SAMPLE == 0
        self.order = order[self.sampled]
        self.sample_rank = np.append(0, np.cumsum(self.sampled))
        self.n = len(text)

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the rows of suffixes that begin with it: from, to."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        alive = np.arange(len(length))
        for step in range(int(length.max(initial=0))):
            alive = alive[(step < length[alive]) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = symbols[alive, length[alive] - 1 - step]
            low[alive] = self.starts[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.starts[symbol] + self.tree.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of rows: back, word by word, to the next sampled one."""
        rows = rows.astype(np.int64)
        out, steps, waiting = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(waiting):
            here = self.sampled[rows[waiting]]
            done = waiting[here]
            out[done] = self.order[self.sample_rank[rows[done]]] + steps
            waiting = waiting[~here]
            if len(waiting):
                symbol, rank = self.tree.symbol_and_rank(rows[waiting])
                rows[waiting] = self.starts[symbol] + rank
                steps += 1
        return out


def find(words_hash: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of each occurrence in a shard's words; a phrase never spans two documents."""
    n_docs = len(first) - 1
    if not len(phrases.length) or not len(words_hash):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(phrases.vocabulary, words_hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[at] == words_hash, at + 2, 1)
    # each document is followed by one word that no phrase has; the whole by the end symbol
    gap = np.arange(n_docs).repeat(np.diff(first))
    text = np.ones(len(symbol) + n_docs + 1, np.int64)
    text[np.arange(len(symbol)) + gap] = symbol
    text[-1] = 0
    # words that no phrase has are no use side by side: one of them stands for a run
    other = text == 1
    keep = np.ones(len(text), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    back = np.flatnonzero(keep)
    index = FMIndex(text[keep], len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.length)
    many = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(many)), many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[phrase]
    place = back[index.locate(rows)]
    to_word = np.cumsum(np.append(0, np.bincount(np.arange(len(symbol)) + gap, minlength=len(text))))
    return to_word[place], phrase


def _let_go(shared: Broadcast) -> None:
    """Frees a worker's copy of a broadcast value, if its file is there to read it again."""
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)


@tidy
def _mark(blocks: list[Broadcast], keep: list[str], mode: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch, limit=SHARD_BYTES):
            words = words_of(data, offsets, ALNUM_LOWER)
            hashes, first = words.hashes(), words.first
            edge = np.zeros(len(words.start) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(part.num_rows)]  # an item may have phrases in two blocks
            for shared in blocks:
                phrases = shared.value
                place, phrase = find(hashes, first, phrases)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + phrases.length[phrase], -1)
                many = np.diff(phrases.item_first)[phrase]
                item = phrases.items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_first[phrase], many)] if len(phrase) else np.empty(0, np.int64)
                doc = np.repeat(np.searchsorted(first, place, side="right") - 1, many)
                for pair in np.unique(doc * max(1, len(phrases.names)) + item).tolist():
                    items[pair // len(phrases.names)].add(phrases.names[pair % len(phrases.names)])
                if len(blocks) > 1:
                    del phrases
                    _let_go(shared)
            listed = [sorted(x) for x in items]
            hit = np.cumsum(edge[:-1]) > 0
            before = np.append(0, np.cumsum(hit))
            n_hit = before[first[1:]] - before[first[:-1]]
            if mode == "text":
                yield _without_spans(part, keep, words, hit, n_hit, data, offsets)
                continue
            arrays = [part.column(c) for c in keep] + [pa.array(np.diff(first), pa.int64())]
            names = [*keep, "n_words"]
            if mode == "spans":
                starts = np.flatnonzero(np.diff(hit, prepend=False) & hit | hit & np.isin(np.arange(len(hit)), first)) if len(hit) else np.empty(0, np.int64)
                ends = np.flatnonzero(hit & (~np.append(hit[1:], False) | np.isin(np.arange(len(hit)) + 1, first))) + 1 if len(hit) else starts
                stops = np.searchsorted(starts, first)
                spans = [[{"first": int(starts[i] - first[d]), "last": int(ends[i] - first[d]) - 1} for i in range(stops[d], stops[d + 1])] for d in range(part.num_rows)]
                arrays += [pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(listed, pa.list_(pa.string()))]
                names += ["spans", "items"]
            else:
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
                arrays += [pa.array(n_hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)]
                names += ["n_hit", "n_items", "items_sha256", "contaminated"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _without_spans(part: pa.RecordBatch, keep: list[str], words, hit: np.ndarray, n_hit: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Texts without the bytes from the first to the last word of each merged span."""
    texts = as_text(part.column("text")).to_pylist()
    for d in np.flatnonzero(n_hit):
        own = slice(words.first[d], words.first[d + 1])
        flags = np.concatenate([[False], hit[own], [False]])
        starts, ends = np.flatnonzero(flags[1:] & ~flags[:-1]), np.flatnonzero(~flags[1:] & flags[:-1]) - 1
        out, at = [], offsets[d]
        for a, b in zip(starts, ends, strict=True):
            out.append(data[at : words.start[own][a]].tobytes())
            at = words.end[own][b]
        out.append(data[at : offsets[d + 1]].tobytes())
        texts[d] = b"".join(out).decode()
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in keep], names=keep)


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    """The benchmark's phrases, block by block in item order."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        held.append((row.item_id, row.text))
        size += len(row.text or "") // 5 + 1
        if size > BLOCK_WORDS:
            yield phrases_of(held, width)
            held, size = [], 0
    if held:
        yield phrases_of(held, width)


def _run(docs: DataFrame, benchmark: DataFrame, width: int, keep: list[str], mode: str, columns: str) -> DataFrame:
    spark = docs.sparkSession
    on_workers(spark)
    source = docs.select(*(docs[c] for c in dict.fromkeys([*keep, "text"])))
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    blocks = [spark.sparkContext.broadcast(phrases) for phrases in _blocks(benchmark, width)]
    if not blocks and mode == "text":
        return source.select(*keep)
    blocks = blocks or [spark.sparkContext.broadcast(phrases_of([], width))]
    return source.mapInArrow(lambda batches: _mark(blocks, keep, mode, batches), ", ".join([*kept, columns] if columns else kept))


def spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, spans (first and last word of each merged hit) and items, a row per document."""
    return _run(docs, benchmark, width, ["doc_id"], "spans", "n_words long, spans array<struct<first:long,last:long>>, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _run(docs, benchmark, width, ["doc_id"], "digest", "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs with every hit span cut out of text."""
    return _run(docs, benchmark, width, docs.columns, "text", "")
