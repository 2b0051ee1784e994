"""PNG media columns: lossless storage of byte payloads as 8-bit grey images, and perceptual hashes of them.

A payload is the value's bytes and as many bytes 255 as make a positive multiple of the width: an image of that width.
Each scan line has the filter (none, sub or up) with the least sum of absolute values, the lines are one zlib stream in
IDAT chunks, and a tEXt chunk keeps the length without padding. Reading tests the signature and each chunk's checksum
and undoes all five filters of the format. The hash is the sign pattern of the low-frequency cosine coefficients
against their median: equal images have equal hashes, and small changes of brightness leave most bits.

A null counts as an empty value. A column that isn't a sound PNG gives null pixels and hash and the reason in `error`.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import column, with_arrays

WIDTH = 576
PADDING = 255
LEVEL = 6
IDAT_BYTES = 1 << 16
HASH_SIDE = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_bytes(value: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A grey PNG that holds value."""
    rows = max(1, -(-len(value) // width))
    image = np.full((rows, width), PADDING, np.uint8)
    image.reshape(-1)[: len(value)] = np.frombuffer(value, np.uint8)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    kinds = np.stack((image, sub, up))
    cost = np.minimum(kinds, -kinds).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((rows, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(rows)]
    stream = zlib.compress(lines.tobytes(), level)
    return b"".join(
        [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)), _chunk(b"tEXt", b"Length\0%d" % len(value))]
        + [_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES)]
        + [_chunk(b"IEND", b"")]
    )


def _unfilter(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The pixels of filtered lines; runs of lines with the same cumulative filter are undone at once."""
    out = lines.copy()
    if len(sub := np.flatnonzero(kinds == 1)):
        out[sub] = np.cumsum(lines[sub], axis=1, dtype=np.uint8)
    y, height = 0, len(lines)
    while y < height:
        kind, stop = kinds[y], y + 1
        if kind == 2:
            while stop < height and kinds[stop] == 2:
                stop += 1
            run = np.cumsum(lines[y:stop], axis=0, dtype=np.uint8)
            out[y:stop] = run + out[y - 1] if y else run
        elif kind in (3, 4):
            above = [int(x) for x in out[y - 1]] if y else [0] * lines.shape[1]
            left = corner = 0
            line = []
            for value, top in zip(lines[y].tolist(), above, strict=True):
                if kind == 3:
                    guess = left + top >> 1
                else:
                    p = left + top - corner
                    a, b, c = abs(p - left), abs(p - top), abs(p - corner)
                    guess = left if a <= b and a <= c else top if b <= c else corner
                left, corner = value + guess & 255, top
                line.append(left)
            out[y] = line
        elif kind > 4:
            raise ValueError(f"line {y} has filter {kind}")
        y = stop
    return out


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels of an 8-bit grey PNG and the length in its tEXt chunk (without one: of all pixels)."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, length, streams, ended = 8, None, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("it ends before IEND")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"the checksum of {kind!r} differs")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            streams.append(body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        ended, at = kind == b"IEND", at + 12 + n
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image without interlacing")
    width, height = header[:2]
    if not width or not height:
        raise ValueError("the image is empty")
    lines = np.frombuffer(zlib.decompress(b"".join(streams)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("the stream's length doesn't fit the header")
    lines = lines.reshape(height, width + 1)
    pixels = _unfilter(lines[:, 1:], lines[:, 0])
    return pixels, pixels.size if length is None else length


@lru_cache(16)
def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi / (2 * n) * np.outer(np.arange(HASH_SIDE), 2 * np.arange(n) + 1))


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the image's mean form exceed the median of all but the first."""
    low = _cosines(pixels.shape[0]) @ (pixels.astype(np.float64) @ _cosines(pixels.shape[1]).T) / pixels.size
    low = np.round(low, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode(df: DataFrame, value: str = "text", png: str = "png", size: str = "n_bytes") -> DataFrame:
    """df with a PNG of each value (a string's UTF-8 or binary) in place of the value, and the value's length in bytes. A null is stored as empty; columns that have these names already are replaced."""
    at = column(df, value)

    def compute(batch: pa.RecordBatch) -> list:
        values = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
        return [pa.array([png_bytes(x) for x in values], pa.binary()), pa.array([len(x) for x in values], pa.int64())]

    return with_arrays(df, compute, [T.StructField(png, T.BinaryType()), T.StructField(size, T.LongType())], (value,))


def decode(df: DataFrame, png: str = "png") -> DataFrame:
    """df with what its PNG column holds: pixels (binary, row by row), image_hash (binary, 8 bytes), stored_bytes and error; columns that have these names
    already are replaced."""
    at = column(df, png)

    def compute(batch: pa.RecordBatch) -> list:
        pixels, hashes, lengths, errors = [], [], [], []
        for data in batch.column(at).to_pylist():
            try:
                image, length = read_png(data or b"")
                found = image.tobytes(), cosine_hash(image), length, None
            except (ValueError, zlib.error, struct.error) as error:
                found = None, None, None, str(error)
            for out, x in zip((pixels, hashes, lengths, errors), found, strict=True):
                out.append(x)
        return [pa.array(pixels, pa.binary()), pa.array(hashes, pa.binary()), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())]

    kinds = [("pixels", T.BinaryType()), ("image_hash", T.BinaryType()), ("stored_bytes", T.LongType()), ("error", T.StringType())]
    return with_arrays(df, compute, [T.StructField(*x) for x in kinds])
