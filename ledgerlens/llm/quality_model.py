"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text fall into bins. Boosting goes around the features in turn: each time a tree of a few
leaves is fitted to the gradient over one feature's bins and added to that feature's lookup table, in
small steps; then the same over the grids of those feature pairs that explain most of what is left. A
score is the sum of a table value per feature and pair, added up by vectorised bin look-ups.

Only features go in: no label, language, source or id. At most SAMPLE labelled rows (those with the
smallest hash of their doc_id, a documented bound) are learnt from.

Defined results: a null text counts as empty and is scored like any other; labels that are null, or of
documents that don't exist, are not learnt from, a document's repeated labels count as their largest.
With no labels, or one class only, every score is the (smoothed) share of label 1. Repeated documents are
scored alike, rows with a null doc_id like any other (they are held out only if the empty text's crc32 says so).
A text of any length is turned into arrays as a whole. An empty table gives an empty result; extra columns,
whatever their names, are ignored (`keep_good` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, on_workers, pieces, tidy, words_of
from .ngram_join import shingles

#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, STEP, LEAVES = 200, 60, 0.15, 3
THRESHOLD = 0.3
_LINES = (np.arange(256) != 10, np.arange(256, dtype=np.uint8))
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]),
    "stop": np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"]),
    "mark": np.isin(np.arange(256), [ord(c) for c in "!?"]),
    "beyond": np.arange(256) > 127,
}
NAMES = ["log_words", "word_length", "longest_word", *(f"share_{k}" for k in _CLASSES), "distinct_words", "distinct_windows", "distinct_lines", "line_words", "short_words", "top_word", "lines_unended", "odd_ends"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text."""
    n = len(offsets) - 1
    words = words_of(data, offsets, SPACED)
    counts = words.counts()
    many = np.maximum(counts, 1).astype(float)
    length = words.end - words.start
    out = [np.log1p(counts)]

    def total(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values, dtype=np.int64))
        return sums[first[1:]] - sums[first[:-1]]

    solid = np.maximum(total(length, words.first), 1).astype(float)
    out.append(solid / many)
    longest = np.zeros(n)
    some = counts > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, words.first[:-1][some])
    out.append(np.log1p(longest))
    out += [total(held[data], offsets) / solid for held in _CLASSES.values()]
    hashes, owner = words.hashes(), words.owner()
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[1:] != owner[:-1])
    out.append(total(new, words.first) / many)
    _, windows = shingles(hashes, words.first, 3)
    out.append(np.diff(windows) / np.maximum(counts - 2, 1))
    lines = words_of(data, offsets, _LINES)
    n_lines = np.maximum(lines.counts(), 1)
    _, distinct = shingles(lines.hashes(), lines.first, 1)
    out.append(np.diff(distinct) / n_lines)
    out.append(np.log1p(counts / n_lines))
    out.append(total(length <= 3, words.first) / many)
    starts = np.flatnonzero(new)
    top = np.zeros(n)
    if len(starts):
        np.maximum.at(top, owner[starts], np.diff(np.append(starts, len(order))))
    out.append(top / many)
    last = words.data[words.end - 1] if len(words.end) else np.empty(0, np.uint8)
    ended = np.isin(lines.data[lines.end - 1], [ord(c) for c in ".!?:"]) if len(lines.end) else np.empty(0, bool)
    out.append(total(~ended, lines.first) / n_lines)
    out.append(total(_CLASSES["symbol"][last] | _CLASSES["mark"][last], words.first) / many)
    return np.stack(out, axis=1)


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in {k for pair in self.pairs for k in pair}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over ordered bins: the best splits, one after the other."""
    parts = [(0, len(gradient))]
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))

    def gain(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, a
        left, right = g[at] - g[a], g[b] - g[at]
        found = left**2 / (h[at] - h[a] + 1) + right**2 / (h[b] - h[at] + 1)
        best = int(np.argmax(found))
        return float(found[best] - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)), int(at[best])

    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        parts.remove(best[2:])
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four, its gain and leaf values."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    best, out = 0.0, np.zeros_like(gradient)
    rows, columns = gradient.shape
    for a in range(1, rows):
        for b in range(1, columns):
            gain = 0.0
            parts = []
            for r in ((0, a), (a, rows)):
                for c in ((0, b), (b, columns)):
                    x, w = (t[r[1], c[1]] - t[r[0], c[1]] - t[r[1], c[0]] + t[r[0], c[0]] for t in (g, h))
                    gain += x * x / (w + 1)
                    parts.append((r, c, x / (w + 1)))
            if gain > best:
                best = gain
                out = np.zeros_like(gradient)
                for r, c, value in parts:
                    out[r[0] : r[1], c[0] : c[1]] = value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    width = len(NAMES)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(width)]
    pair_edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(width)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], [], pair_edges, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(width)]
    total = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slope()
            step = STEP * _tree(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)), LEAVES)
            table += step
            total += step[bins[k]]
    coarse = [np.searchsorted(pair_edges[k], x[:, k], side="right") for k in range(width)]
    size = [len(e) + 1 for e in pair_edges]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * size[b] + coarse[b], values, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slope()
    gains = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            step = STEP * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            rows = features(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("labelled"), part.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["labelled", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> AdditiveModel:
    """Learns from at most `sample` labelled rows outside the held-out fold; rows of one doc_id with the same features count once, however many there are."""
    on_workers(docs.sparkSession)
    known = labels.filter(labels["doc_id"].isNotNull() & labels[label].isNotNull() & ~held_out(labels["doc_id"], folds))
    known = known.groupBy(known["doc_id"].cast("long").alias("labelled")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    # at most `sample` rows of two numbers
    source = docs.join(F.broadcast(known), docs["doc_id"] == known["labelled"]).select(known["labelled"].alias("labelled"), known["label"].alias("label"), docs["text"].alias("text"))
    rows = source.mapInArrow(_features, "labelled long, label int, x array<double>").distinct()
    rows = rows.orderBy(F.xxhash64("labelled", "x"), "labelled", "x").limit(sample).select("label", "x").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y))  # the same model whatever the order of rows
    return fit(x[order], y[order])


@tidy
def _score(model: AdditiveModel, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            scores = model.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores)], names=[*keep, "score"])


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    on_workers(docs.sparkSession)
    source = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"], folds).alias("held_out"), docs["text"].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(lambda b: _score(model, ["doc_id", "held_out"], b), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    on_workers(docs.sparkSession)
    names = docs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                yield part.filter(pa.array(model.score(features(data, offsets)) >= threshold))

    return docs.select(*(docs[c] for c in names)).mapInArrow(run, docs.schema)
