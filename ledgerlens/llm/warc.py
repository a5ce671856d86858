"""WARC archives with a two-level capture index.

Pages are put in order of their reversed-host URL key, so each task writes archives of gzip members
in key order, and beside each the index of its captures: blocks of index lines, each compressed by
itself, and behind them the archive's block directory (first key and place of each block). A look-up
bisects the archives' key ranges (one row for each archive of some 256 MB), then an archive's directory,
reads the block, and then the records' byte ranges.

Of records with equal payloads of at least MIN_PAYLOAD bytes, the one with the smallest page_id is a
response and the others revisit it; which is found by a partial aggregate over digests.

Defined results: a null html is an empty payload, a null url an empty key; rows with a null page_id
are written as responses of their own. Rows that share a page_id and payload are all responses if
theirs is the smallest. An html of any length is one record, held whole while it is written or read.
An empty table gives an empty result; extra columns are ignored. A task that runs again writes new files;
only files that the surviving attempts name are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, buckets, cut, drop_folder, file_system, make_folder, new_folder, on_workers, tidy

MIN_PAYLOAD = 100
#: Captures in a compressed index block.
BLOCK_LINES = 1000
#: Bytes of payload in an archive, about.
ARCHIVE_BYTES = 256 << 20
#: Gaps up to so many bytes between wanted records are read along.
GAP = 1 << 16
_RECORD_DATE = "2024-01-01T00:00:00Z"  # fixed, so archives are the same in every run
_ARCHIVE = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("archive", pa.string()), ("index", pa.string()), ("directory", pa.int64()), ("captures", pa.int64())])
_ARCHIVE_SQL = "first_key string, last_key string, archive string, index string, directory long, captures long"
_WANTED_SQL = "archive string, index string, offset long, length long, key string"
_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PAGE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url) -> F.Column:
    """The reversed-host key of a URL: com,example,www)/path?query."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^.*@|:[0-9]*$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _name(page_id: int | None) -> str:
    """A record's id; the page's number can be read from it."""
    return f"<urn:uuid:{uuid.UUID(int=page_id % 2**64 | 1 << 64)}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _number(name: str) -> int | None:
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 != 1:
        return None
    value &= 2**64 - 1
    return value - 2**64 if value >> 63 else value


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, n_payload: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit of another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_payload}\r\n\r\n".encode()
    kind, more = "response", ""
    if refers_to is not None:
        kind, payload = "revisit", b""
        more = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {_name(refers_to)}\r\n"
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_name(page_id)}\r\nWARC-Date: {_RECORD_DATE}\r\nWARC-Target-URI: {uri}\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + http + payload + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of a record's gzip member."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


@tidy
def _write(folder: str, block_lines: int, archive_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    out = None
    blocks: list[tuple[str, int, int]] = []
    lines: list[str] = []
    place = index_place = size = captures = 0
    first_key = last_key = ""
    marked: tuple | None = None

    def end_block(key: str) -> None:
        nonlocal index_place, captures
        packed = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
        index.write(packed)
        blocks.append((key, index_place, len(packed)))
        index_place += len(packed)
        captures += len(lines)
        lines.clear()

    def end_archive() -> pa.RecordBatch:
        if lines:
            end_block(block_key)
        index.write(gzip.compress(json.dumps(blocks).encode(), 6, mtime=0))
        out.close()
        index.close()
        row = (first_key, last_key, f"{name}.warc.gz", f"{name}.idx", index_place, captures)
        blocks.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARCHIVE, strict=True)], schema=_ARCHIVE)

    block_key = ""
    for batch in batches:
        keys, ids, refers = (batch.column(c).to_pylist() for c in ("key", "page_id", "refers_to"))
        for key, page, url, html, digest, other in zip(keys, ids, batch.column("url").to_pylist(), as_text(batch.column("html")), batch.column("digest").to_pylist(), refers, strict=True):
            if other is not None:
                marked = (key, page, digest, other)
                continue
            other = marked[3] if marked is not None and marked[:3] == (key, page, digest) else None
            if out is None:
                name = f"part-{uuid.uuid4().hex}"
                out, index = fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{base}/{name}.idx", compression=None)
                place = index_place = size = captures = 0
                first_key = key
            payload = html.as_buffer().to_pybytes()
            member = record(page, url or "", payload, digest, other, len(payload))
            out.write(member)
            if not lines:
                block_key = key
            lines.append(json.dumps([key, page, place, len(member)]))  # no line ends inside, whatever the key has
            last_key = key
            place += len(member)
            size += len(payload)
            if len(lines) >= block_lines:
                end_block(block_key)
            if size >= archive_bytes:
                yield end_archive()
                out = None
    if out is not None:
        yield end_archive()


def write(pages: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives and index files to folder; a row for each archive: first_key, last_key, archive, index, directory (where its block directory begins), captures."""
    spark = pages.sparkSession
    on_workers(spark)
    html = F.coalesce(pages["html"], F.lit(""))
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), surt(pages["url"]).alias("key"))
    heavy = source.filter((F.octet_length("html") >= MIN_PAYLOAD) & F.col("page_id").isNotNull())
    first = heavy.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only pages that revisit another are named, so no payload goes through the join of hot digests; cut, so that Spark can split those
    repeats = heavy.select("key", "page_id", "digest").join(cut(first.select("digest", "first_id")), "digest").filter("page_id > first_id")
    # they go to their page by the order of keys, each just before its page
    marks = repeats.select("key", "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.col("first_id").alias("refers_to")).distinct()
    rows = source.select("key", "page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to")).unionByName(marks)
    sorted_pages = rows.repartitionByRange(buckets(pages), "key", "page_id").sortWithinPartitions("key", "page_id", "digest", F.col("refers_to").asc_nulls_last())
    make_folder(spark, folder)
    return cut(sorted_pages.mapInArrow(lambda b: _write(folder, block_lines, archive_bytes, b), _ARCHIVE_SQL))


def _block(fs, base: str, index: str, offset: int, length: int) -> list[tuple[str, int | None, int, int]]:
    """(key, page_id, offset, length) of the captures in a block."""
    with fs.open_input_file(f"{base}/{index}") as f:
        return [tuple(json.loads(line)) for line in gzip.decompress(f.read_at(length, offset)).decode().split("\n")]


def _members(fs, path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """Record bytes of sorted ranges, near ones in one read."""
    with fs.open_input_file(path) as f:
        at = 0
        while at < len(ranges):
            to, stop = at + 1, sum(ranges[at])
            while to < len(ranges) and ranges[to][0] - stop <= GAP and stop - ranges[at][0] < 4 << 20:
                stop = sum(ranges[to])
                to += 1
            held = f.read_at(stop - ranges[at][0], ranges[at][0])
            for offset, length in ranges[at:to]:
                yield held[offset - ranges[at][0] : offset - ranges[at][0] + length]
            at = to


class CaptureIndex:
    """Look-ups by URL key. archives: (first_key, last_key, archive, index, directory) in key order, one for each archive."""

    def __init__(self, archives: list[tuple], folder: str):
        self.fs, self.base = file_system(folder)
        self.archives = sorted(archives)
        self.last_keys = [x[1] for x in self.archives]
        self.held: tuple[str, list] = ("", [])

    def _directory(self, index: str, begin: int) -> list[list]:
        """[first key, offset, length] of an archive's blocks."""
        if self.held[0] != index:  # keys come in order, so the last one is mostly the one wanted
            with self.fs.open_input_file(f"{self.base}/{index}") as f:
                self.held = (index, json.loads(gzip.decompress(f.read_at(f.size() - begin, begin))))
        return self.held[1]

    def blocks(self, key: str) -> Iterator[tuple[str, str, int, int]]:
        """(archive, index, offset, length) of each block that may have the key."""
        at = bisect_left(self.last_keys, key)  # archives before end below the key
        while at < len(self.archives) and self.archives[at][0] <= key:
            _, _, archive, index, begin = self.archives[at]
            directory = self._directory(index, begin)
            first = max(0, bisect_left(directory, key, key=lambda x: x[0]) - 1)  # a key's captures may begin in the block before
            for _, offset, length in directory[first : bisect_right(directory, key, key=lambda x: x[0])]:
                yield archive, index, offset, length
            at += 1

    def captures(self, key: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """Records whose key is the given one."""
        for archive, *block in self.blocks(key):
            found = [x[2:] for x in _block(self.fs, self.base, *block) if x[0] == key]
            yield from (parse(x) for x in _members(self.fs, f"{self.base}/{archive}", found))


@tidy
def _find(index, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of sorted keys, by bisection."""
    look_up = CaptureIndex(index.value, folder)
    for batch in batches:
        rows = [(*block, key) for key in batch.column("key").to_pylist() for block in look_up.blocks(key)]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000], strict=True)], names=["archive", "index", "offset", "length", "key"])


@tidy
def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the wanted keys; rows come sorted by block, and a block is read once for all its keys in a batch."""
    fs, base = file_system(folder)
    held: tuple[tuple, list] = ((), [])
    for batch in batches:
        wanted: dict[tuple, set[str]] = {}
        for *block, key in zip(*(batch.column(c).to_pylist() for c in ("archive", "index", "offset", "length", "key")), strict=True):
            wanted.setdefault(tuple(block), set()).add(key)
        for block, keys in wanted.items():
            if held[0] != block:
                held = (block, _block(fs, base, *block[1:]))
            rows: list[list] = [[] for _ in _PAGE]
            for member in _members(fs, f"{base}/{block[0]}", [x[2:] for x in held[1] if x[0] in keys]):
                fields, http, payload = parse(member)
                kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != stated):
                    raise ValueError(f"{block[0]}: a payload of {fields['WARC-Record-ID']} is damaged")
                values = (_number(fields["WARC-Record-ID"]), size, stated, kind, _number(fields["WARC-Refers-To"]) if kind == "revisit" else None)
                for row, value in zip(rows, values, strict=True):
                    row.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _PAGE, strict=True)], schema=_PAGE)


def look_up(keys: DataFrame, archives: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture of keys' distinct values of key.

    Keys in order are sought by bisection; then the blocks found, not the keys, are dealt out, so a key with
    many captures is read by many tasks.
    """
    spark: SparkSession = keys.sparkSession
    on_workers(spark)
    tasks = tasks or buckets(keys)
    # one row for each archive of many megabytes
    index = spark.sparkContext.broadcast([tuple(x) for x in archives.select("first_key", "last_key", "archive", "index", "directory").collect()])
    wanted = keys.select("key").filter("key IS NOT NULL").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    found = wanted.mapInArrow(lambda b: _find(index, folder, b), _WANTED_SQL)
    dealt = found.repartition(tasks, "index", "offset").sortWithinPartitions("archive", "offset", "key")
    return dealt.mapInArrow(lambda b: _read(folder, b), _PAGE_SQL)


def round_trip(pages: DataFrame) -> DataFrame:
    """A row per page as read back from archives by look-ups of all pages' keys; the archives are deleted again."""
    spark: SparkSession = pages.sparkSession
    folder = new_folder(spark, "warc")
    archives = write(pages, folder)
    out = cut(look_up(pages.select(surt(pages["url"]).alias("key")), archives, folder, buckets(pages)))
    drop_folder(spark, folder)
    return out
