"""Audit of how filters overlap: what each one removes in every order, from counts of failure masks.

Each document gets a mask of the filters that it fails; masks are counted per part (and among good and toxic
labels). A subset-zeta transform turns the counts into survivors of every subset of filters, and each step of an
order is the difference of two neighbouring subsets: no order reads the documents again.

`failures` marks the documents (JVM functions only), `count_masks` counts, `audit` transforms. A filter is a Column
over `text`; the one for repeated texts needs the whole table and is a bit of its own.

Defined results: a null or empty text is an empty text without words. A null lang counts with the empty string.
Repeated texts are told by SHA-256; of equal texts those with the smallest doc_id don't fail, however many rows share it.
A row with a null doc_id never counts as a repeat or makes one of another, and has no labels. Rows that share a doc_id
count each. A document is good or toxic if any of its labels' rows says so; without labels it is neither. Texts of any
length are read whole. An empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, on_workers

_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: More filters than this give more orders than rows are wanted of (8! is 40,320 a part).
MOST_FILTERS = 8


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def standard_filters(text: Column, held: Column) -> dict[str, Column]:
    """Failure conditions by letter; held: the text's words."""
    return {
        "A": F.size(held) < 100,
        "B": 100 * F.size(F.array_distinct(held)) < 80 * F.size(held),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters=standard_filters) -> DataFrame:
    """A row per document: doc_id, part, mask. Bit k is the k-th of filters; the next bit: a smaller doc_id has the same text."""
    text = F.coalesce(docs["text"], F.lit(""))
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("part"), text.alias("text"), words(text).alias("held"))
    own = filters(F.col("text"), F.col("held"))
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(own.values())]
    # texts and words end here: from now on a row has some 60 bytes
    marked = cut(source.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")))
    least = marked.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    # joined by text and doc_id, so the copies of one text are dealt out like others
    least = least.select(F.col("digest").alias("its"), "least")
    repeat = F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), F.lit(1 << len(own))).otherwise(F.lit(0))
    return marked.join(least, (F.col("digest") == F.col("its")) & (F.col("doc_id") == F.col("least")), "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))


def count_masks(failed: DataFrame, labels: DataFrame, n_filters: int) -> DataFrame:
    """part, total, good, toxic: arrays of document counts by mask."""
    known = labels.select(labels["doc_id"].cast("long").alias("_its"), (labels["quality"] == 1).cast("int").alias("q"), (labels["toxic"] == 1).cast("int").alias("t"))
    known = known.filter("_its IS NOT NULL AND (q = 1 OR t = 1)").groupBy("_its").agg(F.coalesce(F.max("q"), F.lit(0)).alias("good"), F.coalesce(F.max("t"), F.lit(0)).alias("toxic"))
    # rows without an id find no label whatever they are joined by: a number of their own keeps them apart
    spread = failed.withColumn("_key", F.coalesce("doc_id", -1 - F.monotonically_increasing_id())).withColumn("_named", F.col("doc_id").isNotNull())
    told = spread.join(known, (F.col("_key") == F.col("_its")) & F.col("_named"), "left")
    one = told.select("part", "mask", F.lit(1).alias("total"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    sums = one.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("total", "good", "toxic")))
    by_mask = lambda c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0))) for m in range(1 << n_filters))).alias(c)
    return sums.groupBy("part").agg(*map(by_mask, ("total", "good", "toxic")))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of each row's counts by mask, for every set of filters the documents that fail none of it (subset-zeta transform)."""
    held = counts.copy()
    size = counts.shape[-1]
    for k in range(size.bit_length() - 1):
        halves = held.reshape(*counts.shape[:-1], -1, 2, 1 << k)  # a view: without and with filter k
        halves[..., 1, :] += halves[..., 0, :]
    return held[..., size - 1 - np.arange(size)]


_COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _steps(letters: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(letters)
    orders = list(itertools.permutations(range(n)))
    added = np.array(orders)
    after = np.cumsum(1 << added, axis=1)
    before = after - (1 << added)
    names = pa.array([letters_of for order in orders for letters_of in ["".join(letters[k] for k in order)] * n])
    step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))
    everything = (1 << n) - 1
    for batch in batches:
        for row in range(batch.num_rows):
            alive = survivors(np.array([batch.column(c)[row].as_py() for c in ("total", "good", "toxic")], np.int64))
            lost = alive[:, before] - alive[:, after]
            removed = lost[0]
            failing = alive[0, 0] - alive[0, 1 << np.arange(n)]
            alone = alive[0, everything - (1 << np.arange(n))] - alive[0, everything]
            over_all = np.zeros(n, np.int64)
            np.add.at(over_all, added, removed)
            columns = [alive[0, after], removed, failing[added] - removed, alone[added], lost[1], lost[2], over_all[added]]
            part = pa.array([batch.column("part")[row].as_py()] * len(names), pa.string())
            yield pa.RecordBatch.from_arrays([part, names, step, *(pa.array(c.ravel()) for c in columns)], names=[c.split()[0] for c in _COLUMNS.split(", ")])


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of all filters and step: what is kept and removed there, and the filter's sums over all orders."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters, not {letters!r} ({math.factorial(len(letters))} orders)")
    on_workers(counts.sparkSession)
    return counts.mapInArrow(lambda b: _steps(letters, b), _COLUMNS)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four standard filters and repeated texts (E)."""
    return audit(count_masks(failures(docs), labels, 5), "ABCDE")
