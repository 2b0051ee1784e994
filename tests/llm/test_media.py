from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(value):
    pixels, length = media.read_png(media.png_bytes(value))
    assert length == len(value) and pixels.tobytes() == value + b"\xff" * (pixels.size - len(value)) and pixels.size % 576 == 0 and pixels.size >= 576


def filtered(image, kinds):
    """Scan lines with the given filters, pixel by pixel."""
    out = b""
    for y, kind in enumerate(kinds):
        line = bytearray([kind])
        for x in range(image.shape[1]):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(image[y, x]) - (0, a, b, a + b >> 1, nearest)[kind]) % 256)
        out += bytes(line)
    return out


def test_all_filters():
    rng = np.random.default_rng(0)
    for _ in range(20):
        image = rng.integers(0, 256, (9, 7), dtype=np.uint8)
        data = zlib.compress(filtered(image, rng.integers(0, 5, 9)))
        png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", data[:20]) + media._chunk(b"IDAT", data[20:]) + media._chunk(b"IEND", b"")
        assert (media.read_png(png)[0] == image).all()


def test_hash_is_that_of_the_cosine_sums():
    image = np.random.default_rng(1).integers(0, 256, (4, 9), dtype=np.uint8)
    low = np.array([[sum(float(image[y, x]) * np.cos(np.pi * u * (2 * y + 1) / 8) * np.cos(np.pi * v * (2 * x + 1) / 18) for y in range(4) for x in range(9)) for v in range(8)] for u in range(8)]) / 36
    low = np.round(low, 6).reshape(-1)
    assert media.cosine_hash(image) == np.packbits(low > np.median(low[1:])).tobytes()


def empty(width, height):
    """A sound PNG without pixels."""
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(bytes(height * (width + 1)))) + media._chunk(b"IEND", b"")


def test_no_rows(spark):
    assert media.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frames(spark):
    rows = [(1, "text"), (2, None), (3, ""), (4, "long " * 50_000), (1, "text")]
    stored = media.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    found = media.decode(stored).collect()
    for r, (_, text) in zip(found, rows, strict=True):
        value = (text or "").encode()
        assert r.error is None and r.n_bytes == r.stored_bytes == len(value) and bytes(r.pixels).startswith(value)
    assert found[0] == found[4]
    bad = spark.createDataFrame([(1, bytes(found[0].png)[:-20]), (2, b"junk"), (3, None), (4, bytes(found[0].png).replace(b"IDAT", b"IDAX")), (5, empty(0, 3)), (6, empty(3, 0)), (7, empty(0, 0))], "id int, png binary")
    assert all(r.error and r.pixels is None for r in media.decode(bad).collect())
    assert media.decode(stored.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tessera.llm.queries import op6_png

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = {}
    for r in op6_png(spark, sf_dir).collect():
        value = texts[r.doc_id]
        payload = value + b"\xff" * (-len(value) % 576 or (0 if value else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(value), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        own = (r.media_bytes, r.media_sha256, r.feature)
        assert seen.setdefault(value, own) == own
