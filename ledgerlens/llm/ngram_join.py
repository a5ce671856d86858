"""Join of documents by the Jaccard similarity of their word shingles, and near-duplicate groups.

A document's set holds 64-bit hashes of its distinct shingles. Its parity sketch XORs one bit per
element, so two sketches differ in at most as many bits as the sets differ in elements. Linked sets
have sizes in one size band or in neighbours, and differ in at most d elements, which the band bounds:
of more than d sketch blocks at least one is equal. Block values are dealt out in Spark (blobs of numbers by
hash; exact copies of a set count once), and documents that share a value are candidates:

1. each value's candidates are held against its most connected member, a linear number of pairs;
2. where a value still joins several groups, pairs between the groups are compared by whole sketches
   (in chunks, so a value of any size is spread over tasks), and what the sketches can't rule out
   is verified on the sets.

Pairs inside a group already found aren't verified again: no link between different groups is lost.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle. Rows with a null doc_id are linked with
nothing and have no component. Rows that share a doc_id count as separate documents of that id. A text of any length is turned into
arrays as a whole. An empty table gives an empty result; extra columns, whatever their names, are ignored
(`keep_one` keeps them). Of a group the smallest doc_id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_LOWER, U64, blob_of, buckets, cut, groups, ids_of, mix, on_workers, pieces, scale, tidy, words_of

#: Block values that a task gathers before it sends them.
GATHERED = 1_000_000
#: From so many members of one value in a task on, they go around the value's own bucket.
CROWD = 32
#: Members of one value that are compared in one chunk.
CHUNK = 1024

#: Pairs of one set that one task compares, about; and how many such sets are sent to every task, at most.
HEAVY, LISTED = 2_000, 10_000

LINK_PERCENT = 90


def size_bands(most: int, percent: int = LINK_PERCENT) -> np.ndarray:
    """Smallest sizes of the bands: two linked sets lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def differences(bands: np.ndarray, percent: int = LINK_PERCENT) -> np.ndarray:
    """By label: in how many elements linked sets can differ at most."""
    top = bands[1:] - 1  # the largest size in each band
    same = (200 - 2 * percent) * top // (100 + percent)
    cross = np.append(0, (100 - percent) * top[:-1] // percent)
    return np.maximum(same, cross)


def blocks_of(bands: np.ndarray, percent: int = LINK_PERCENT) -> np.ndarray:
    """By label: more blocks than linked sets can differ in, by what blocks of less than two elements a set is likely to have."""
    most, least = differences(bands, percent), bands[:-1].astype(float)
    out = most + 1
    for _ in range(8):
        mean = least / out
        out = np.where(most > 0, most + 1 + np.ceil(1.3 * out * np.exp(-mean) * (1 + mean)).astype(np.int64), 1)
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    h = np.zeros(len(place), np.uint64)
    length = np.minimum(counts, width)[owner]
    for k in range(width):
        has = k < length
        h = np.where(has, mix(h * U64(0x9FB21C651E98DF25) + words[np.minimum(place + k, max(len(words) - 1, 0))]), h) if len(words) else h
    h = mix(h + length.astype(np.uint64))
    # the owner takes the place of the highest bits for one sort of all
    order = np.lexsort((h, owner)) if len(h) else np.empty(0, np.int64)
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))


def block_keys(sets: np.ndarray, first: np.ndarray, label: np.ndarray, n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set its blocks' keys (63 bits), end to end, where each set's begin, and how many bits each block has set; a key stands for label, block number and the block's parity bits (65536 in a block)."""
    start = np.append(0, np.cumsum(n_blocks))
    size = np.diff(first)
    many = np.repeat(n_blocks.astype(np.uint64), size)
    block = ((sets >> U64(32)) * many >> U64(32)) + np.repeat(start[:-1].astype(np.uint64), size)
    code = np.sort((block << U64(16)) | (sets & U64(0xFFFF)))
    at = groups(code)
    odd = (np.diff(np.append(at, len(code))) & 1).astype(bool)
    code = code[at[odd]]
    sums = np.zeros(start[-1], np.uint64)
    number = (code >> U64(16)).astype(np.int64)
    held = np.bincount(number, minlength=start[-1])
    if len(code):
        runs = groups(number)
        sums[number[runs]] = np.add.reduceat(mix((code & U64(0xFFFF)) + U64(1)), runs)
    inner = (np.arange(start[-1]) - np.repeat(start[:-1], n_blocks)).astype(np.uint64)
    return mix(mix(sums) + (np.repeat(label.astype(np.uint64), n_blocks) << U64(32)) + inner) >> U64(1), start, held


_BANDS = size_bands(1 << 40)


def _fingerprints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D))))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("owners", pa.binary()), ("prints", pa.binary())])
_MESSAGE_SQL = "bucket int, kind byte, keys binary, owners binary, prints binary"
_ROW = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
_ROW_SQL = "kind byte, a long, b long, c long"


def _message(bucket: int, kind: int, *blobs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, kind, *blobs), _MESSAGE, strict=True)], schema=_MESSAGE)


@tidy
def _sketch(width: int, percent: int, n: int, most_keys: int, crowd: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: documents with their set's size and fingerprint; 1: block values by bucket; 2: values whose members went around; 3: those members."""
    bands, most, n_blocks = _BANDS, differences(_BANDS, percent), blocks_of(_BANDS, percent)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    gathered, turn = 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        keys, prints = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held.clear()
        order = np.argsort(keys)
        keys, prints = keys[order], prints[order]
        starts = groups(keys)
        many = np.diff(np.append(starts, len(keys)))
        around = np.repeat(many >= crowd, many)
        if around.any():
            turn += 1
            yield _message((int(keys[0] & U64(0x3FFFFFFF)) + turn) % n, 3, blob_of(keys[around]), b"", blob_of(prints[around]))
            known = keys[starts[many >= crowd]]
            at = scale(known << U64(1), n)
            for k in np.unique(at):
                yield _message(int(k), 2, blob_of(known[at == k]), b"", b"")
            keys, prints = keys[~around], prints[~around]
        stops = np.searchsorted(scale(keys << U64(1), n), np.arange(n + 1).astype(np.uint64))
        for k in range(n):
            mine = slice(stops[k], stops[k + 1])
            if stops[k + 1] > stops[k]:
                used, owner = np.unique(prints[mine], return_inverse=True)
                yield _message(k, 1, blob_of(keys[mine]), blob_of(owner.astype("<u4" if len(used) > 1 << 16 else "<u2")), blob_of(used))

    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = words_of(data, offsets, SPACED_LOWER)
            sets, first = shingles(words.hashes(), words.first, width)
            size, prints = np.diff(first), _fingerprints(sets, first)
            turn += 1
            yield _message((turn * 7919 + int(prints[0]) % n) % n, 0, blob_of(ids_of(part)), blob_of(size.astype("<i8")), blob_of(prints))
            _, at = np.unique(prints, return_index=True)
            band = np.searchsorted(bands, size[at], side="right") - 1
            at, band = at[size[at] > 0], band[size[at] > 0]
            taken = np.zeros(len(size), bool)
            taken[at] = True
            some = sets[np.repeat(taken, size)]
            order = np.argsort(at)
            at, band = at[order], band[order]
            begins = np.append(0, np.cumsum(size[at]))
            for label in (band, band + 1):
                alone = most[label] == 0  # no two different sets of such sizes are linked
                label = np.where(alone, 0, label)
                count = np.where(alone, 1, n_blocks[label])
                keys, starts, bits = block_keys(some, begins, label, count)
                # blocks of one bit or none are like those of many sets. They are left out where, of the blocks that
                # a linked set must have alike, others remain
                thin = bits < 2
                spare = np.add.reduceat(thin.astype(np.int64), starts[:-1]) < count - most[label] if len(count) else alone
                keep = np.repeat(~alone, count) & ~(thin & np.repeat(spare, count))
                held.append((keys[keep], np.repeat(prints[at], count)[keep]))
                gathered += len(held[-1][0])
            if gathered >= most_keys:
                yield from flush()
                gathered = 0
    if held:
        yield from flush()


def _rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = [*columns, np.zeros(len(columns[0]), np.int64)][:3]
    for at in range(0, len(columns[0]), 20_000):
        part = [c[at : at + 20_000] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int8)), *(pa.array(c.astype(np.int64, copy=False)) for c in part)], schema=_ROW)


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: doc_id, size, fingerprint; kind 1: block value, fingerprint, for values that several sets have."""
    kept: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            bucket, kind = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            keys, owners, prints = (batch.column(k)[row].as_py() for k in (2, 3, 4))
            if kind == 0:
                yield from _rows(0, *(np.frombuffer(x, np.int64) for x in (keys, owners, prints)))
                continue
            keys, prints = np.frombuffer(keys, np.uint64), np.frombuffer(prints, np.int64)
            if kind == 3:
                yield from _rows(1, keys.view(np.int64), prints)
                continue
            owner = np.frombuffer(owners, "<u4" if len(prints) > 1 << 16 else "<u2") if kind == 1 else None
            kept.setdefault(bucket, []).append((keys, prints[owner] if kind == 1 else np.zeros(len(keys), np.int64), np.full(len(keys), kind == 2)))
    for parts in kept.values():
        keys, prints, flag = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.lexsort((prints, flag, keys))
        keys, prints, flag = keys[order], prints[order], flag[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1]) | (flag[1:] != flag[:-1])
        keys, prints, flag = keys[new], prints[new], flag[new]
        many = np.diff(np.append(groups(keys), len(keys)))
        shared = np.repeat(many > 1, many) & ~flag
        yield from _rows(1, keys[shared].view(np.int64), prints[shared])


@tidy
def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in pieces(batch):
            words = words_of(data, offsets, SPACED_LOWER)
            sets, first = shingles(words.hashes(), words.first, width)
            prints = _fingerprints(sets, first)
            blobs = [blob_of(sets[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(blobs, pa.binary())], names=["print", "members"])


@tidy
def _set_sizes(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in pieces(batch):
            words = words_of(data, offsets, SPACED_LOWER)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(shingles(words.hashes(), words.first, width)[1]), pa.int64())], names=["n_shingles"])


@tidy
def _verify(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked[row] = 100 * common >= percent * (len(x) + len(y) - common)
        yield batch.select(["a", "b"]).filter(pa.array(linked))


@tidy
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole parity sketches; their width is a power of two that grows with the set, so that wider ones fold onto narrower."""
    for batch in batches:
        sizes, out = [], []
        for value in batch.column("members"):
            members = np.frombuffer(value.as_buffer(), np.uint64)
            width = 1 << max(8, (2 * len(members) - 1).bit_length())
            bits = np.bincount((members >> U64(8) & U64(width - 1)).astype(np.int64), minlength=width) & 1
            sizes.append(len(members))
            out.append(np.packbits(bits.astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["print", "size", "sketch"])


def _folded(sketches: list[bytes]) -> np.ndarray:
    width = min(map(len, sketches))
    rows = np.zeros((len(sketches), width), np.uint8)
    for k, x in enumerate(sketches):
        rows[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width))
    return rows.view(np.uint64)


def _compare(percent: int, group: pa.Table) -> pa.RecordBatch:
    """Pairs of different groups, of a chunk and another (or itself), that the sketches don't rule out."""
    prints, part, size, side = (group.column(c).to_numpy() for c in ("print", "part", "size", "side"))
    rows = _folded(group.column("sketch").to_pylist())
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    a, b = [], []
    step = max(1, (1 << 20) // max(1, len(right) * rows.shape[1]))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        apart = np.bitwise_count(rows[i, None, :] ^ rows[None, right, :]).sum(-1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (size[i, None] + size[None, right])
        x, y = np.nonzero(near & (part[i, None] != part[None, right]))
        a.append(prints[i[x]])
        b.append(prints[right[y]])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


@tidy
def _compare_sorted(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by value and chunks, so a group is complete when the next begins."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        names = np.stack([table.column(c).to_numpy() for c in ("key", "one", "two")])
        starts = np.flatnonzero(np.append(True, (names[:, 1:] != names[:, :-1]).any(0)))
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            yield _compare(percent, table.slice(x, y - x))
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield _compare(percent, rest)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches) for the ends of edges (a, b): neighbours' labels and label jumps until nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select(edges["b"].alias("a"), edges["a"].alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")))
        if not step.filter("label <> was").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


@tidy
def _near(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sizes and sketches don't rule out."""
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for row, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)):
            x, y = _folded([x, y])
            near[row] = (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (n + m)
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _beside(pairs: DataFrame, held: DataFrame, end: str, columns: dict[str, str], heavy: int) -> DataFrame:
    """Pairs with columns of held (by print) beside their end a or b.

    A print that stands in many pairs (the centre of a large group) is dealt over several tasks: its row is copied
    for each, and its pairs are spread by their other end.
    """
    wanted = held.select("print", *(F.col(c).alias(to) for c, to in columns.items()))
    counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
    counts = counts.select(F.col(end).alias("_print"), F.ceil(F.col("n") / heavy).cast("int").alias("_parts"))
    rows = counts.limit(LISTED + 1).collect()
    if not rows:
        return pairs.join(wanted, pairs[end] == wanted["print"]).drop("print")
    if len(rows) <= LISTED:
        counts = F.broadcast(pairs.sparkSession.createDataFrame(rows, "_print long, _parts int"))
    other = "b" if end == "a" else "a"
    spread = pairs.join(counts, F.col(end) == F.col("_print"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"), F.lit(0))).drop("_print", "_parts")
    copied = wanted.join(counts, F.col("print") == F.col("_print"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_print", "_parts")
    return spread.join(copied, (F.col(end) == F.col("print")) & (F.col("_salt") == F.col("_copy"))).drop("print", "_salt", "_copy")


def _verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, heavy: int) -> DataFrame:
    """The linked ones of pairs: first by sketches, which are small, then by sets."""
    pairs = cut(pairs)
    small = _beside(_beside(pairs, sketches, "a", {"size": "n", "sketch": "x"}, heavy), sketches, "b", {"size": "m", "sketch": "y"}, heavy)
    pairs = cut(small.filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b", "n", "m", "x", "y").mapInArrow(lambda t: _near(percent, t), "a long, b long"))
    both = _beside(_beside(pairs, sets, "a", {"members": "x"}, heavy), sets, "b", {"members": "y"}, heavy)
    return cut(both.select("a", "b", "x", "y").mapInArrow(lambda t: _verify(percent, t), "a long, b long"))


def link(docs: DataFrame, width: int = 3, percent: int = LINK_PERCENT, *, gathered: int = GATHERED, crowd: int = CROWD, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and n_links (verified links of the document's set to different sets)."""
    on_workers(docs.sparkSession)
    n = buckets(docs)
    source = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    sent = source.mapInArrow(lambda t: _sketch(width, percent, n, gathered, crowd, t), _MESSAGE_SQL).repartitionById(n, "bucket")
    met = cut(sent.mapInArrow(_meet, _ROW_SQL))
    held = met.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("print"))
    posted = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("print"))
    degree = posted.groupBy("print").agg(F.count(F.lit(1)).alias("degree"))
    first = held.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    wanted = degree.join(first, "print").select("doc_id", "print")
    sets = source.join(wanted.hint("shuffle_hash"), "doc_id").select("text", F.col("print").alias("wanted")).mapInArrow(lambda t: _sets(width, t), "print long, members binary")
    sets = cut(sets.join(wanted.select("print"), "print", "left_semi").dropDuplicates(["print"]))

    # 1. everyone with the most connected member of each value
    hub = posted.join(degree, "print").groupBy("key").agg(F.max_by("print", F.struct("degree", "print")).alias("hub"))
    pairs = posted.join(hub, "key").filter("print <> hub").select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct()
    sketches = cut(sets.mapInArrow(_sketches, "print long, size long, sketch binary"))
    found = _verified(pairs, sets, sketches, percent, heavy)

    # 2. what the groups found so far leave open
    label = components(found).select(F.col("node").alias("print"), "label")
    parted = cut(posted.join(label, "print", "left").select("key", "print", F.coalesce("label", "print").alias("part")))
    still = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high")
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    open_ = parted.join(still.select("key", chunks.alias("chunks")), "key")
    mine = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = open_.select("key", "print", "part", mine.alias("mine"), other.alias("other")).join(sketches, "print")
    dealt = dealt.select("key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "print", "part", "size", (F.col("mine") > F.col("other")).cast("int").alias("side"), "sketch")
    dealt = dealt.repartition(n, "key", "one", "two").sortWithinPartitions("key", "one", "two")
    rest = dealt.mapInArrow(lambda t: _compare_sorted(percent, t), "a long, b long").distinct().join(found, ["a", "b"], "left_anti")
    more = _verified(rest, sets, sketches, percent, heavy)

    links = found.union(more)
    label = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = first.join(label.withColumnRenamed("node", "print"), "print")
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    linked = named.join(least, "label").select("print", F.col("least"))
    known = first.join(linked, "print", "left").join(ends.withColumnRenamed("node", "print"), "print", "left")
    known = known.select("print", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = (F.col("n_shingles") == 0)
    out = held.join(known, "print", "left")
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).alias("n_links"))
    nameless = docs.filter(docs["doc_id"].isNull()).select(F.lit(None).cast("long").alias("doc_id"), docs["text"].alias("text"))
    nameless = nameless.mapInArrow(lambda t: _set_sizes(width, t), "n_shingles long").select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long"), F.lit(0).cast("long"))
    return cut(out.withColumn("n_links", F.col("n_links").cast("long")).union(nameless))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those whose group has a smaller doc_id; rows with a null doc_id stay."""
    gone = link(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct().hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
