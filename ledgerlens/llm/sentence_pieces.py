"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the vocabulary holds a whitespace marker after another character, so merges never
cross the place where a run of markers begins. A text is therefore cut there, each distinct marked
word of the corpus is segmented once by the library (`unit_table`), and the ids are joined back by position.
Vocabularies that break the rule are refused and encoded text by text.

A word whose ids decode to something else is marked in the table; texts that have one, or a marker of their
own, are decoded by the library as a whole, all others decode to themselves.

Defined results: a null or empty text has no ids and decodes to ''. Rows are independent, so repeated
rows and ids, ties and extra columns pass through. A text of any length is one row, its ids one value. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_text, cut, drop_folder, new_folder, on_workers, pieces, tidy
from .unit_table import GATHERED, LOOKED_UP, build, gathered

MARK = "▁"
_MARK = MARK.encode()
#: Behind the ids of a word that decodes to another text.
ODD = 0xFFFFFFFF
_LOADED: dict[str, PieceUnits] = {}


def splits_at_markers(model) -> bool:
    """True if no piece has a marker behind another character."""
    for i in range(len(model)):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                return False
    return True


class PieceUnits:
    """Texts as marked words, each without its first marker."""

    kind = "<u4"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.probe = self.model.encode("a")
        self.whole = not splits_at_markers(self.model) or self.model.decode(self.probe) != "a"
        decimals = [f",{i}".encode() for i in range(len(self.model))]
        self.digits, self.digits_length = np.frombuffer(b"".join(decimals), np.uint8), np.array([len(x) for x in decimals], np.int64)
        self.digits_start = np.cumsum(self.digits_length) - self.digits_length

    @staticmethod
    def marks(data: np.ndarray) -> np.ndarray:
        """Where the vocabulary's own marker stands in a text."""
        at = np.flatnonzero(data[: max(0, len(data) - 2)] == _MARK[0])
        return at[(data[at + 1] == _MARK[1]) & (data[at + 2] == _MARK[2])]

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        marker = data == 0x20
        at = self.marks(data)
        begins = marker.copy()
        begins[at] = True
        for k in range(3):
            marker[at + k] = True
        behind = np.append(False, marker[:-1])[: len(data)]
        behind[offsets[:-1][offsets[:-1] < len(data)]] = True  # a marker is put in front of each text
        starts = np.flatnonzero(begins & ~behind)
        # a text's first word begins with the text, if it has any
        texts = offsets[:-1][np.diff(offsets) > 0]
        begin = np.concatenate([texts, starts])
        order = np.argsort(begin, kind="stable")
        inner = np.concatenate([texts, starts + np.where(data[starts] == 0x20, 1, 3)])[order]
        begin = begin[order]
        first = np.searchsorted(begin, offsets)
        end = np.append(begin[1:], len(data))[: len(begin)]
        return Words(data, inner, end, first)

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(units, num_threads=1)
        for k, unit in enumerate(units):
            if not unit:  # a lone marker: what stands behind a word in 'a '
                found[k] = self.model.encode("a ", num_threads=1)[len(self.probe) :]
        decoded = self.model.decode([self.probe + x for x in found], num_threads=1)
        found = [ids if back == f"a {unit}" else [*ids, ODD] for unit, ids, back in zip(units, found, decoded, strict=True)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), self.kind)


def units_for(path: str) -> PieceUnits:
    if path not in _LOADED:
        _LOADED[path] = PieceUnits(path)
    return _LOADED[path]


def _arrays(ids: list[list[int]], decoded: list[str], full: bool) -> list[pa.Array]:
    counts = pa.array([len(x) for x in ids], pa.int64())
    if full:
        return [counts, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
    return [counts, *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column]) for column in ([",".join(map(str, x)) for x in ids], decoded))]


@tidy
def _encode_whole(path: str, keep: list[str], names: list[str], full: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text by text, for vocabularies that can't be cut at markers."""
    model = units_for(path).model
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            ids = model.encode(as_text(part.column("_text")).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([*(part.column(f"_{k}") for k in range(len(keep))), *_arrays(ids, model.decode(ids, num_threads=1), full)], names=names)


@tidy
def _encode(path: str, shared: Broadcast, keep: list[str], names: list[str], full: bool, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, segmenter = shared.value, units_for(path)
    held: list[tuple[pa.RecordBatch, Words, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *(len(x.data) for _, x, _ in held)])
        n_units = np.cumsum([0, *(len(x.start) for _, x, _ in held)])
        units = Words(*(np.concatenate([getattr(x, f) + s if f != "data" else x.data for (_, x, _), s in zip(held, shift, strict=False)]) for f in ("data", "start", "end")), np.concatenate([*(x.first[:-1] + s for (_, x, _), s in zip(held, n_units, strict=False)), n_units[-1:]]))
        texts = np.concatenate([*(x[:-1] + s for (_, _, x), s in zip(held, shift, strict=False)), shift[-1:]])
        rows = pa.Table.from_batches([x for x, _, _ in held]).combine_chunks()
        held.clear()
        codes, many, begin, values = table.values(segmenter, units)
        last = np.where(many > 0, begin + many - 1, 0)
        odd = (many > 0) & (values[last] == ODD) if len(values) else np.zeros(len(many), bool)
        many = many - odd
        # texts that may decode to something else
        strange = np.append(0, np.cumsum(odd[codes]))
        strange = strange[units.first[1:]] > strange[units.first[:-1]]
        strange[np.searchsorted(texts, segmenter.marks(units.data), side="right") - 1] = True
        counts = np.append(0, np.cumsum(many[codes]))[units.first]
        n_ids = np.diff(counts)
        all_ids = gathered(values, begin[codes], many[codes]).astype(np.int32) if full or strange.any() else None
        plain = memoryview(units.data.tobytes())
        decoded = {d: segmenter.model.decode(all_ids[counts[d] : counts[d + 1]].tolist()) for d in np.flatnonzero(strange).tolist()}
        if full:
            ids = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(all_ids))
            columns = [ids, pa.array([decoded[d] if d in decoded else bytes(plain[a:b]).decode() for d, (a, b) in enumerate(zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True))], pa.string())]
        else:
            own = gathered(values, begin, many)  # the ids of the distinct words, then their digits, then the texts'
            stop = np.append(0, np.cumsum(segmenter.digits_length[own]))
            to = np.cumsum(many)
            size = stop[to] - stop[to - many]
            digits = gathered(gathered(segmenter.digits, segmenter.digits_start[own], segmenter.digits_length[own]), stop[to - many], size[: len(many)])
            start = np.cumsum(size) - size
            spots = np.append(0, np.cumsum(size[codes]))[units.first].tolist()
            written = memoryview(gathered(digits, start[codes], size[codes]).tobytes())
            columns = [
                pa.array([hashlib.sha256(written[a + 1 : b]).hexdigest() for a, b in zip(spots[:-1], spots[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(decoded[d].encode() if d in decoded else plain[a:b]).hexdigest() for d, (a, b) in enumerate(zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True))], pa.string()),
            ]
        out = pa.Table.from_arrays([*(rows.column(f"_{k}") for k in range(len(keep))), pa.array(n_ids, pa.int64()), *columns], names=names)
        yield from out.combine_chunks().to_batches(max_chunksize=5000)

    size = 0
    for batch in batches:
        for part, data, offsets in pieces(batch, "_text"):
            held.append((part, segmenter.units(data, offsets), offsets))
            size += len(held[-1][1].start) + part.num_rows
            if size >= most:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def encode(docs: DataFrame, model_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, folder: str | None = None, looked_up: int = LOOKED_UP, sent: int = GATHERED) -> DataFrame:
    """keep columns, n_tokens, ids ARRAY<INT> and decoded; with digests, SHA-256 of both in their place.

    The table of words lies in folder (or a new one in the shared folder) while the result is read; with digests, the result is computed at once and the folder deleted.
    """
    spark = docs.sparkSession
    on_workers(spark)
    tail = {"n_tokens": "long", **({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>", "decoded": "string"})}
    names = [*keep, *tail]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {v}" for k, v in tail.items())])
    # own names inside: the kept columns may have any
    narrow = docs.select(*(docs[c].alias(f"_{k}") for k, c in enumerate(keep)), docs[text].alias("_text"))
    if units_for(model_path).whole:
        return narrow.mapInArrow(lambda b: _encode_whole(model_path, list(keep), names, not digests, b), schema)
    folder = folder or new_folder(spark, "pieces")
    table, _ = build(docs.select(docs[text].alias("text")), lambda: units_for(model_path), folder, PieceUnits.kind, gathered=sent)
    shared = spark.sparkContext.broadcast(table)
    out = narrow.mapInArrow(lambda b: _encode(model_path, shared, list(keep), names, not digests, looked_up, b), schema)
    if digests:
        out = cut(out)
        drop_folder(spark, folder)
    return out


def decode(tokens: DataFrame, model_path: str, *, ids: str = "ids") -> DataFrame:
    """Adds decoded STRING, the library's decode of each row's ids (null: '')."""
    on_workers(tokens.sparkSession)

    @F.pandas_udf("string")
    def text_of(column):
        model = units_for(model_path).model
        return column.map(lambda x: model.decode([int(i) for i in x]) if x is not None else "")

    return tokens.withColumn("decoded", text_of(tokens[ids]))
