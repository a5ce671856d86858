"""Whitening of embeddings by a covariance that is summed in tiles.

Entries become whole numbers: x = floor(64 * c) + 1,000,000. The fit list has each distinct x vector once.

1. Distinct vectors and their per-dimension sums S are exact.
2. Dimensions are cut into blocks; a pair of blocks is a tile. Column blocks of the fit list are dealt by row-block,
   centred, and multiplied pair by pair; each task sums its tiles over its row-blocks, and the sums per tile are added
   up in two steps, so a tile's parts never meet in one task in a number that grows with the input.
3. The tiles of one vector length are assembled and eigendecomposed (as many numbers as dimensions squared, whatever
   the number of rows).
4. The fit list is projected and its covariance compared with the identity; then all rows are projected.

Vectors of different lengths are fitted apart from one another; what a length needs lies in a file of its own in the
shared folder, which tasks read when they meet that length.

Defined results: a null vector, or one that holds a null, NaN or infinite entry, is dropped. Empty vectors have no
components and give no rows. Rows with a null or repeated vec_id each get rows of their own. A component whose variance
is nothing but rounding (below dimensions * 2^-50 of the trace, as with fewer distinct vectors than dimensions) can't be
scaled: its `whitened` is null, and it plays no part in identity_error; `explained` is null where the trace is 0.
Entries beyond +-2^40 count as such; a deviation that no long holds is null. An empty table gives an empty result; extra
columns, whatever their names, are ignored. Equal eigenvalues keep any one basis, the same for all rows.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, drop_folder, file_system, make_folder, new_folder, on_workers, tidy

STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 16
FARTHEST = 1 << 40
#: Dimensions in a block, entries in a row-block, and parts in which a tile's sums are added up first.
BLOCK, ROW_BLOCK, PARTS = 32, 1 << 19, 64
LONGEST = (1 << 63) - 1


# ---- vectors -----------------------------------------------------------------------------------


def vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x values end to end, where each row's begin, which rows are whole)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    starts = column.offsets.to_numpy()
    held = column.values
    fine = pc.fill_null(pc.is_finite(held), False).to_numpy(zero_copy_only=False)
    flawed = np.append(0, np.cumsum(~fine))
    whole = (flawed[starts[1:]] == flawed[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    c = np.nan_to_num(pc.fill_null(held, 0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(STEPS * c), -FARTHEST, FARTHEST).astype(np.int64) + OFFSET
    return x, starts, whole


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of x) for each vector length of a batch, empty vectors left out."""
    x, starts, whole = vectors(column)
    length = np.diff(starts)
    for d in np.unique(length[whole & (length > 0)]).tolist():
        rows = np.flatnonzero(whole & (length == d))
        yield d, rows, x[starts[rows][:, None] + np.arange(d)]


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row in as few bytes an entry as that row needs, less OFFSET; equal rows have equal bytes."""
    held = matrix - OFFSET
    far = np.maximum(held.max(1), -(held.min(1) + 1))
    size = np.select([far < 1 << 7, far < 1 << 15, far < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(held)
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        for row, blob in zip(rows.tolist(), held[rows].astype(f"<i{s}"), strict=True):
            out[row] = blob.tobytes()
    return out


def unpacked(blobs: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(blobs), d), np.int64)
    size = np.array([len(b) // d for b in blobs])
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        out[rows] = np.frombuffer(b"".join(blobs[k] for k in rows.tolist()), f"<i{s}").reshape(-1, d)
    return out + OFFSET


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, _, matrix in by_length(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), d, np.int32)), pa.array(packed(matrix), pa.binary())], names=["dims", "x"])


def _packed_rows(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[int, np.ndarray]]:
    """(dims, matrix) of about at_once entries, in the order of the rows; a matrix has one length."""
    for batch in batches:
        dims, blobs = batch.column("dims").to_numpy(), batch.column("x").to_pylist()
        for d in np.unique(dims).tolist():
            rows, step = np.flatnonzero(dims == d), max(1, at_once // d)
            for at in range(0, len(rows), step):
                yield d, unpacked([blobs[k] for k in rows[at : at + step].tolist()], d)


# ---- files by length ---------------------------------------------------------------------------


def _put(folder: str, name: str, **arrays: np.ndarray) -> None:
    fs, base = file_system(folder)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(f"{base}/{name}.npz") as f:
        f.write(held.getvalue())


@functools.lru_cache(maxsize=8)
def _get(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{name}.npz") as f, np.load(io.BytesIO(f.readall())) as held:
        return {k: held[k] for k in held.files}


def _done(d: int) -> pa.Table:
    return pa.table({"dims": pa.array([d], pa.int32())})


def _put_sums(folder: str, group: pa.Table) -> pa.Table:
    d = group.column("dims")[0].as_py()
    place = group.column("place").to_numpy()
    sums = np.empty(d, np.int64)
    sums[place] = group.column("total").to_numpy()
    _put(folder, f"sums-{d}", n=np.int64(group.column("n")[0].as_py()), sums=sums)
    return _done(d)


@tidy
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's number of vectors and sums: a row for each dimension."""
    held: dict[int, list] = {}
    for d, matrix in _packed_rows(batches, ROW_BLOCK):
        n, total = held.get(d, (0, 0))
        held[d] = [n + len(matrix), total + matrix.sum(0)]
    for d, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(total)], names=["dims", "place", "n", "total"])


# ---- tiles -------------------------------------------------------------------------------------


@tidy
def _column_blocks(block: int, entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column blocks of row-blocks; a row-block is named by its task and turn, so a repeated task gives the same."""
    from pyspark import TaskContext

    task, turn = TaskContext.get().partitionId(), 0
    for d, matrix in _packed_rows(batches, entries):
        cuts = list(range(0, d, block))
        blobs = [np.concatenate([np.frombuffer(b, np.uint8) for b in _columns(matrix[:, c : c + block])]).tobytes() for c in cuts]
        name = (task << 32) + turn
        turn += 1
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts), pa.int64()), pa.array([d] * len(cuts), pa.int32()), pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([len(matrix)] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], names=["row_block", "dims", "block", "height", "held"])


def _columns(matrix: np.ndarray) -> tuple[bytes, bytes]:
    """The entry size, then the entries column after column."""
    held = matrix - OFFSET
    far = max(int(held.max()), -int(held.min()) - 1)
    size = 1 if far < 1 << 7 else 2 if far < 1 << 15 else 4 if far < 1 << 31 else 8
    return bytes([size]), np.asfortranarray(held.astype(f"<i{size}")).tobytes("F")


def _tile_rows(d: int, tiles: dict[tuple[int, int], np.ndarray], part: int) -> pa.RecordBatch:
    names = list(tiles)
    return pa.RecordBatch.from_arrays([pa.array([d] * len(names), pa.int32()), *(pa.array([k[i] for k in names], pa.int32()) for i in (0, 1)), pa.array([part] * len(names), pa.int32()), pa.array([tiles[k].tobytes() for k in names], pa.binary())], names=["dims", "i", "j", "part", "tile"])


@tidy
def _multiply(folder: str, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by row-block: the products of its column blocks, summed over this task's row-blocks."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % PARTS
    sums: dict[int, dict[tuple[int, int], np.ndarray]] = {}
    now, held = None, {}

    def close() -> None:
        d = now[1]
        own = sums.setdefault(d, {})
        for i in sorted(held):
            for j in range(i, len(held)):
                product = held[i].T @ held[j]
                own[i, j] = own[i, j] + product if (i, j) in own else product

    for batch in batches:
        for row in range(batch.num_rows):
            name, d, k, height, blob = (batch.column(c)[row].as_py() for c in ("row_block", "dims", "block", "height", "held"))
            if now != (name, d):
                if now:
                    close()
                now, held = (name, d), {}
            fit = _get(folder, f"sums-{d}")
            mean = (fit["sums"][k * block : (k + 1) * block] / fit["n"]) - OFFSET
            held[k] = np.frombuffer(blob, f"<i{blob[0]}", offset=1).reshape(-1, height).T - mean
    if now:
        close()
    for d, tiles in sums.items():
        names = list(tiles)
        for at in range(0, len(names), 64):
            yield _tile_rows(d, {k: tiles[k] for k in names[at : at + 64]}, part)


def _add_tiles(group: pa.Table) -> pa.Table:
    d, i, j, part = (group.column(c)[0].as_py() for c in ("dims", "i", "j", "part"))
    total = sum(np.frombuffer(t.as_buffer()) for t in group.column("tile"))
    return pa.Table.from_batches([_tile_rows(d, {(i, j): total}, part)])


def _decompose(folder: str, block: int, group: pa.Table) -> pa.Table:
    """Assembles one length's tiles and writes its components."""
    d = group.column("dims")[0].as_py()
    fit = _get(folder, f"sums-{d}")
    v = np.empty((d, d))
    for i, j, tile in zip(*(group.column(c) for c in ("i", "j", "tile")), strict=True):
        i, j = i.as_py() * block, j.as_py() * block
        tile = np.frombuffer(tile.as_buffer()).reshape(min(block, d - i), min(block, d - j)) / fit["n"]
        v[i : i + block, j : j + block] = tile
        v[j : j + block, i : i + block] = tile.T
    values, basis = np.linalg.eigh((v + v.T) / 2)
    _put(folder, f"basis-{d}", values=values[::-1].copy(), basis=basis[:, ::-1].copy(), trace=np.float64(np.trace(v)))
    return _done(d)


# ---- projection --------------------------------------------------------------------------------


def _scaled(folder: str, d: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first components as columns over the roots of their eigenvalues, which of them have any variance, and their shares."""
    held = _get(folder, f"basis-{d}")
    values, trace = held["values"][:most], float(held["trace"])
    alive = (values > d * 2.0**-50 * trace) & (values > 0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1)), 0)
    return held["basis"][:, :most] * scale, alive, np.maximum(values, 0) / trace if trace > 0 else np.full(len(values), np.nan)


def project(folder: str, matrix: np.ndarray, most: int) -> np.ndarray:
    d = matrix.shape[1]
    fit = _get(folder, f"sums-{d}")
    return (matrix - fit["sums"] / fit["n"]) @ _scaled(folder, d, most)[0]


def deviations(matrix: np.ndarray, n: int, sums: np.ndarray) -> np.ma.MaskedArray:
    """Sums over dimensions of (n * x - S)^2, exact; masked where no long holds them."""
    far = np.abs(matrix - OFFSET).max(initial=0) + OFFSET
    if n * int(far) + int(np.abs(sums).max(initial=0)) <= LONGEST:
        apart = n * matrix - sums
        if int(np.abs(apart).max(initial=0)) ** 2 * matrix.shape[1] <= LONGEST:
            return np.ma.masked_array((apart * apart).sum(1), mask=np.zeros(len(matrix), bool))
    about = ((n * matrix.astype(float) - sums) ** 2).sum(1)
    out = np.ma.masked_array(np.zeros(len(matrix), np.int64), mask=about > 2.0 * LONGEST)
    for k in np.flatnonzero(~out.mask).tolist():
        exact = sum((n * x - s) ** 2 for x, s in zip(matrix[k].tolist(), sums.tolist(), strict=True))
        out[k] = exact if exact <= LONGEST else np.ma.masked
    return out


@tidy
def _moments(folder: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of whitened values and of their products, a row for each place of the matrix [1, w]' [1, w]."""
    held: dict[int, np.ndarray] = {}
    for d, matrix in _packed_rows(batches, ROW_BLOCK):
        w = np.hstack([np.ones((len(matrix), 1)), project(folder, matrix, most)])
        held[d] = held.get(d, 0) + w.T @ w
    for d, sums in held.items():
        flat = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["dims", "place", "total"])


def _put_error(folder: str, most: int, group: pa.Table) -> pa.Table:
    d = group.column("dims")[0].as_py()
    m = np.empty(group.num_rows)
    m[group.column("place").to_numpy()] = group.column("total").to_numpy()
    m = m.reshape(round(len(m) ** 0.5), -1)
    mean = m[0, 1:] / m[0, 0]
    covariance = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    alive = _scaled(folder, d, most)[1]
    apart = np.abs(covariance - np.eye(len(mean)))[np.ix_(alive, alive)]
    _put(folder, f"error-{d}", error=np.float64(apart.max() if alive.any() else np.nan))
    return _done(d)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@tidy
def _whiten(folder: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, rows, matrix in by_length(batch.column("embedding")):
            fit = _get(folder, f"sums-{d}")
            _, alive, explained = _scaled(folder, d, most)
            k = len(alive)
            error = float(_get(folder, f"error-{d}")["error"])
            ids = batch.column("vec_id").take(pa.array(rows))
            for at in range(0, len(rows), max(1, (1 << 16) // k)):
                part = matrix[at : at + max(1, (1 << 16) // k)]
                whitened = project(folder, part, most)
                far = deviations(part, int(fit["n"]), fit["sums"])
                each = np.repeat(np.arange(len(part)), k)
                tiled = lambda x: np.tile(x, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(part)).take(pa.array(each)), pa.array(tiled(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(each), int(fit["n"]))),
                        pa.array(far.data[each], mask=far.mask[each]), pa.array(whitened.ravel(), mask=tiled(~alive)), pa.array(tiled(explained), mask=np.isnan(tiled(explained))),
                        pa.array(np.full(len(each), error), mask=np.full(len(each), np.isnan(error))),
                    ],
                    names=[c.split()[0] for c in _OUT.split(", ")],
                )


# ---- whole -------------------------------------------------------------------------------------


def fit(embeddings: DataFrame, folder: str, most: int = COMPONENTS, *, block: int = BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Writes sums, components and identity errors of every vector length to folder; the fit list (dims, x)."""
    n = buckets(embeddings)
    source = embeddings.select(embeddings["embedding"].cast("array<double>").alias("embedding"))
    listed = cut(source.mapInArrow(_pack, "dims int, x binary").distinct())
    sums = listed.mapInArrow(_sums, "dims int, place int, n long, total long").groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    cut(sums.groupBy("dims").applyInArrow(lambda g: _put_sums(folder, g), "dims int"))
    blocks = listed.mapInArrow(lambda b: _column_blocks(block, row_block, b), "row_block long, dims int, block int, height int, held binary")
    dealt = blocks.repartition(n, "row_block").sortWithinPartitions("row_block", "dims", "block")
    tile_sql = "dims int, i int, j int, part int, tile binary"
    tiles = dealt.mapInArrow(lambda b: _multiply(folder, block, b), tile_sql)
    tiles = tiles.groupBy("dims", "i", "j", "part").applyInArrow(_add_tiles, tile_sql)
    tiles = tiles.groupBy("dims", "i", "j").applyInArrow(_add_tiles, tile_sql)
    cut(tiles.groupBy("dims").applyInArrow(lambda g: _decompose(folder, block, g), "dims int"))
    moments = listed.mapInArrow(lambda b: _moments(folder, most, b), "dims int, place int, total double").groupBy("dims", "place").agg(F.sum("total").alias("total"))
    cut(moments.groupBy("dims").applyInArrow(lambda g: _put_error(folder, most, g), "dims int"))
    return listed


def apply(embeddings: DataFrame, folder: str, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of rows whose lengths were fitted into folder."""
    source = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding"))
    return source.mapInArrow(lambda b: _whiten(folder, most, b), _OUT)


def whiten(embeddings: DataFrame, most: int = COMPONENTS, **sizes: int) -> DataFrame:
    """Fits on all rows and applies to all rows; the files are deleted again."""
    spark = embeddings.sparkSession
    on_workers(spark)
    folder = new_folder(spark, "whitening")
    make_folder(spark, folder)
    fit(embeddings, folder, most, **sizes)
    out = cut(apply(embeddings, folder, most))
    drop_folder(spark, folder)
    return out
