"""Screen pictures as rows of pixels: PNG files (8 bits a channel, not interlaced), named by role and number."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, palette, grey with alpha, RGBA.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SCHEMA = "file string, role string, frame_no int, width int, height int, data binary"


class UnreadableImageError(ValueError):
    """A file that is no PNG, or of a kind that isn't read."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from rows of differences: to the left, above, their mean, or the nearer of three (Paeth)."""
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        how, line = int(rows[y, 0]), rows[y, 1:].copy()
        if how == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            left = np.zeros(step, np.int64)
            corner = np.zeros(step, np.int64)
            for x in range(0, stride, step):
                up = above[x : x + step].astype(np.int64)
                if how == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = (line[x : x + step] + guess) & 255
                line[x : x + step] = left
                corner = up
        out[y] = above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4 (RGBA) of a PNG file."""
    if data[:8] != _SIGNATURE:
        raise UnreadableImageError("not a PNG file")
    packed, palette, header = [], None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise UnreadableImageError("a PNG file without a header")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise UnreadableImageError("a PNG file that is interlaced, or not of 8 bits a channel")
    step = _CHANNELS[colour]
    held = _unfiltered(zlib.decompress(b"".join(packed)), height, width * step, step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = palette[held[..., 0]]
    else:
        out[..., :3] = held[..., :3] if step >= 3 else held[..., :1]
        if step in (2, 4):
            out[..., 3] = held[..., -1]
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file, role, frame_no, width, height, data (RGBA) of the PNG files in a folder; 'Front Desk 12.png' is frame 12 of the role Front Desk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                image = decode(content)
                stem = re.sub(r"%20|\+", " ", file.rsplit("/", 1)[-1]).rsplit(".", 1)[0]
                named = re.fullmatch(r"(.*?)[\s_-]*(\d*)", stem, re.S)
                rows.append((file, named[1], int(named[2] or 0), image.shape[1], image.shape[0], image.tobytes()))
            yield pd.DataFrame(rows, columns=["file", "role", "frame_no", "width", "height", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
