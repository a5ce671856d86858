"""Near-duplicate groups by b-bit MinHash.

A document's set holds 64-bit hashes of its distinct word shingles. Of every set HASHES minima are taken; a band is
a run of ROWS minima, and sets that share a band's value are candidates. Of each minimum only the lowest BITS bits
are kept, packed into a signature of HASHES * BITS / 8 bytes. Two minima of different sets agree in these bits by
chance once in 2^BITS, so the share of equal lanes m estimates the similarity as (m - C) / (1 - C), C = 2^-BITS.

1. The members of each band value are held against the one that shares most with others, its hub (a linear number of
   pairs). Candidates of a low estimate are dropped; the others' full sets are compared, which gives the links, and
   what each member has and the hub hasn't, or the other way round (its difference).
2. Where a value's members then still lie in several groups, they are compared in chunks, so a value of any size is
   spread over tasks. Two sets differ in just the elements in which their differences to the hub differ, so all pairs
   of a chunk are compared exactly by one product of matrices; only links that join groups leave the task. A member
   without a difference (too unlike the hub) is held against the others by signatures, and confirmed on the full sets.

Candidates are dropped whose estimate is so low that a linked pair would have it with a chance below RISK. A pair at
the threshold of 0.85 shares none of the 32 bands with a chance of 6e-11. Pairs inside a group already found aren't
confirmed again: no link between different groups is lost.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle. Rows with a null doc_id are linked with nothing, have no
component and are kept. Rows that share a doc_id are documents of their own; each is kept if that id is its
component. A text of any length is turned into arrays as a whole. An empty table gives an empty result; extra columns,
whatever their names, are ignored (`keep_one` keeps them). Of a group the smallest doc_id stays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_LOWER, U64, buckets, cut, ids_of, mix, on_workers, pieces, tidy, words_of
from .ngram_join import CHUNK, HEAVY, _beside, _fingerprints, _set_sizes, _sets, components, shingles

LINK_PERCENT = 85
HASHES, ROWS, BITS = 128, 4, 2
#: Chance at which a pair at the threshold may be taken for less by its signature.
RISK = 1e-13
_DRAWN = np.random.Generator(np.random.PCG64(777_2011))
_TURNS = _DRAWN.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FACTORS = _DRAWN.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
#: Estimate from which on a member is compared with the hub, and so has a difference.
HUB_ESTIMATE = 0.25
#: Documents whose ids may go to every task (some 16 bytes each).
FEW = 10_000
#: Set members that are hashed at a time, and columns of a product of matrices.
_AT_ONCE, _COLUMNS = 1 << 16, 1 << 12


def minima(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set (none empty) its HASHES minima: of 32 bits each, of hashes that order the members differently."""
    out = np.full((len(first) - 1, HASHES), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(sets), _AT_ONCE):
        part = sets[at : at + _AT_ONCE]
        low, high = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(part), side="left")
        begins = np.maximum(first[low:high] - at, 0)
        for k in range(HASHES):
            own = np.minimum.reduceat((part ^ _TURNS[k]) * _FACTORS[k], begins)
            # the high half has the order; its own low bits are what a signature keeps
            out[low:high, k] = np.minimum(out[low:high, k], (own >> U64(32)).astype(np.uint32))
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """The value of each band, with the band's number hashed in."""
    out = np.empty((len(least), HASHES // ROWS), np.uint64)
    for band in range(out.shape[1]):
        h = np.full(len(least), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            h = mix(h * U64(0x9FB21C651E98DF25) + least[:, k])
        out[:, band] = h
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, packed: HASHES * BITS / 64 numbers a set."""
    lanes = least.astype(np.uint64) & U64((1 << BITS) - 1)
    each = 64 // BITS
    shifted = lanes.reshape(len(least), HASHES // each, each) << (np.arange(each, dtype=np.uint64) * U64(BITS))
    return np.bitwise_or.reduce(shifted, axis=2)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many lanes signatures (last axis) differ: differing bits are gathered in each lane's lowest, and counted."""
    apart = a ^ b
    for k in range(1, BITS):
        apart |= (a ^ b) >> U64(k)
    lowest = U64(sum(1 << k for k in range(0, 64, BITS)))
    return np.bitwise_count(apart & lowest).sum(-1, dtype=np.int64)


def similarity(n_unequal: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for lanes that are equal by chance."""
    by_chance = 0.5**BITS
    return (1 - n_unequal / HASHES - by_chance) / (1 - by_chance)


@functools.cache
def least_estimate(percent: int, risk: float = RISK) -> float:
    """A linked pair's estimate is below this with a chance below risk (binomial tail of unequal lanes)."""
    p = (1 - percent / 100) * (1 - 0.5**BITS)
    over = 0.0
    for k in range(HASHES, 0, -1):
        over += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if over > risk:
            return float(similarity(np.int64(k)))
    return 1.0


@tidy
def _sketch(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, fingerprint; the bands and signature of a set that the batch has not shown before."""
    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = words_of(data, offsets, SPACED_LOWER)
            sets, first = shingles(words.hashes(), words.first, width)
            size, prints = np.diff(first), _fingerprints(sets, first)
            _, at = np.unique(prints, return_index=True)
            new = np.zeros(len(size), bool)
            new[at] = True
            new &= size > 0
            least = minima(sets[np.repeat(new, size)], np.append(0, np.cumsum(size[new])))
            held, packed = bands(least), signatures(least)
            keys, lanes = [None] * len(size), [None] * len(size)
            for k, row in enumerate(np.flatnonzero(new).tolist()):
                keys[row], lanes[row] = held[k].view(np.int64), packed[k].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part), pa.int64()), pa.array(size, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(lanes, pa.binary())], names=["doc_id", "n_shingles", "print", "keys", "lanes"])


def _lanes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


@tidy
def _likely(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate is `least` or more."""
    for batch in batches:
        if batch.num_rows:
            near = similarity(unequal(_lanes(batch.column("x")), _lanes(batch.column("y")))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))


@tidy
def _held_against(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with whether they are linked, and the elements that one of both sets has."""
    for batch in batches:
        linked, apart = np.zeros(batch.num_rows, bool), []
        for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            differ = np.setxor1d(x, y, assume_unique=True)
            common = (len(x) + len(y) - len(differ)) // 2
            linked[row] = 100 * common >= percent * (common + len(differ))
            apart.append(differ.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked), pa.array(apart, pa.binary())], names=["a", "b", "linked", "apart"])


def _shared_elements(differences: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many elements the differences of each of left and each of right agree: products of 0-1 matrices over the elements that several have."""
    size = np.array([len(x) // 8 for x in differences])
    every = np.frombuffer(b"".join(differences), np.uint64)
    _, element, times = np.unique(every, return_inverse=True, return_counts=True)
    kept = times > 1
    number = np.cumsum(kept) - 1
    owner = np.repeat(np.arange(len(size)), size)[kept[element]]
    column = number[element[kept[element]]]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(kept.sum()), _COLUMNS):
        here = (column >= at) & (column < at + _COLUMNS)
        rows = np.zeros((len(size), min(_COLUMNS, int(kept.sum()) - at)), np.float32)
        rows[owner[here], column[here] - at] = 1
        out += rows[left] @ rows[right].T
    return out


def _forest(parts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a, b join parts that no earlier one has joined."""
    above = {int(p): int(p) for p in np.unique(parts)}

    def top(p: int) -> int:
        while above[p] != p:
            above[p] = p = above[above[p]]
        return p

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(parts[a].tolist(), parts[b].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[x], keep[k] = y, True
    return keep


def _compare(percent: int, group: pa.Table) -> pa.RecordBatch:
    """Of a chunk and another (or itself), pairs of different groups: links that join groups (sure), and pairs that sizes and signatures allow where differences don't tell."""
    prints, part, size, side = (group.column(c).to_numpy() for c in ("print", "part", "n_shingles", "side"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    told = group.column("apart").is_valid().to_numpy(zero_copy_only=False)
    apart = [x or b"" for x in group.column("apart").to_pylist()]
    many = np.array([len(x) // 8 for x in apart])
    rows, least = _lanes(group.column("lanes")), least_estimate(percent)
    sure, likely = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        across = part[i, None] != part[None, right]
        exact = told[i, None] & told[None, right]
        if (across & exact).any():
            differ = many[i, None] + many[None, right] - 2 * _shared_elements(apart, i, right).astype(np.int64)
            common = (size[i, None] + size[None, right] - differ) // 2
            x, y = np.nonzero(across & exact & (100 * common >= percent * (common + differ)))
            sure.append((i[x], right[y]))
        open_ = across & ~exact
        if open_.any():
            x, y = np.nonzero(open_)
            n, m = size[i[x]], size[right[y]]
            near = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (similarity(unequal(rows[i[x]], rows[right[y]])) >= least)
            likely.append((i[x[near]], right[y[near]]))
    ends = lambda held: [np.concatenate([np.empty(0, np.int64), *(x[k] for x in held)]) for k in (0, 1)]
    a, b = ends(sure)
    keep = _forest(part, a, b)
    c, d = ends(likely)
    a, b = prints[np.append(a[keep], c)], prints[np.append(b[keep], d)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) < keep.sum())], names=["a", "b", "sure"])


@tidy
def _compare_sorted(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by value and chunks, so a group is complete when the next begins."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        names = np.stack([table.column(c).to_numpy() for c in ("key", "one", "two")])
        starts = np.flatnonzero(np.append(True, (names[:, 1:] != names[:, :-1]).any(0)))
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            yield _compare(percent, table.slice(x, y - x))
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield _compare(percent, rest)


def _by_sets(pairs: DataFrame, source: DataFrame, first: DataFrame, width: int, percent: int, heavy: int, rare: bool = False) -> DataFrame:
    """pairs with linked and apart, by the full sets of the documents that stand in them. rare: few documents are expected to."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct().join(first, "print").select("doc_id", F.col("print").alias("wanted"))
    wanted = cut(wanted)
    # texts are dealt by id, unless so few of them are wanted that their ids go to every task
    few = rare and wanted.limit(FEW + 1).count() <= FEW
    sets = source.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id").select("text").mapInArrow(lambda t: _sets(width, t), "print long, members binary")
    # rows that share a doc_id may have other texts than the one wanted
    sets = cut(sets.join(wanted.select(F.col("wanted").alias("print")), "print", "left_semi").dropDuplicates(["print"]))
    both = _beside(_beside(pairs, sets, "a", {"members": "x"}, heavy), sets, "b", {"members": "y"}, heavy)
    return cut(both.select("a", "b", "x", "y").mapInArrow(lambda t: _held_against(percent, t), "a long, b long, linked boolean, apart binary"))


def link(docs: DataFrame, width: int = 5, percent: int = LINK_PERCENT, *, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id is its component's)."""
    if not 85 <= percent <= 100:
        raise ValueError("32 bands of 4 minima find all pairs from a similarity of 0.85 on")
    on_workers(docs.sparkSession)
    n = buckets(docs)
    source = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    sketched = cut(source.mapInArrow(lambda t: _sketch(width, t), "doc_id long, n_shingles long, print long, keys array<long>, lanes binary"))
    held = sketched.select("doc_id", "n_shingles", "print")
    # copies of one set count once
    first = held.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    shown = cut(sketched.filter("keys IS NOT NULL").select("print", "n_shingles", "keys", "lanes").dropDuplicates(["print"]))
    lanes = shown.select("print", "n_shingles", "lanes")
    posted = shown.select("print", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    posted = cut(posted.join(shared, "key"))
    # the text that near copies were made from shares the most, so all of a group's values have one hub
    degree = posted.groupBy("print").agg(F.sum("members").alias("degree"))
    hub = posted.join(degree, "print").groupBy("key").agg(F.max_by("print", F.struct("degree", "print")).alias("hub"))
    posted = cut(posted.select("key", "print").join(hub, "key"))

    # 1. everyone with one member of each value
    pairs = cut(posted.filter("print <> hub").select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct())
    near = _beside(_beside(pairs, lanes, "a", {"lanes": "x"}, heavy), lanes, "b", {"lanes": "y"}, heavy)
    near = cut(near.select("a", "b", "x", "y").mapInArrow(lambda t: _likely(min(HUB_ESTIMATE, least_estimate(percent)), t), "a long, b long"))
    against = _by_sets(near, source, first, width, percent, heavy)
    found = against.filter("linked").select("a", "b")

    # 2. what the groups found so far leave open
    label = components(found).select(F.col("node").alias("print"), "label")
    parted = cut(posted.join(label, "print", "left").select("key", "print", "hub", F.coalesce("label", "print").alias("part")))
    still = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high AND members > 2")
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    open_ = parted.join(still.select("key", chunks.alias("chunks")), "key")
    differences = against.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "apart")
    open_ = open_.join(differences, (F.least("print", "hub") == F.col("_a")) & (F.greatest("print", "hub") == F.col("_b")), "left").drop("_a", "_b")
    open_ = open_.withColumn("apart", F.when(F.col("print") == F.col("hub"), F.lit(b"")).otherwise(F.col("apart"))).join(lanes, "print")
    mine, other = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = open_.select("key", "print", "part", "n_shingles", "lanes", "apart", mine.alias("mine"), other.alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "print", "part", "n_shingles", (F.col("mine") > F.col("other")).cast("int").alias("side"), "lanes", "apart")
    dealt = dealt.repartition(n, "key", "one", "two").sortWithinPartitions("key", "one", "two")
    across = cut(dealt.mapInArrow(lambda t: _compare_sorted(percent, t), "a long, b long, sure boolean").distinct())
    rest = across.filter("NOT sure").select("a", "b").join(near, ["a", "b"], "left_anti")
    links = found.union(across.filter("sure").select("a", "b"))
    if not rest.isEmpty():
        links = links.union(_by_sets(cut(rest), source, first, width, percent, heavy, rare=True).filter("linked").select("a", "b"))

    named = first.join(components(links).withColumnRenamed("node", "print"), "print")
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    known = first.join(named.join(least, "label").select("print", "least"), "print", "left").select("print", F.coalesce("least", "doc_id").alias("least"))
    out = held.join(known, "print", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    nameless = docs.filter(docs["doc_id"].isNull()).select(docs["text"].alias("text")).mapInArrow(lambda t: _set_sizes(width, t), "n_shingles long")
    out = out.union(nameless.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")))
    return cut(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, width: int = 5, percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of docs without those whose group has a smaller doc_id; rows with a null doc_id stay."""
    gone = link(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct().hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
