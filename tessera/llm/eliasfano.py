"""Elias-Fano sequences in numpy arrays, and flat files of arrays that are read memory-mapped.

A rising sequence of n numbers below u keeps log2(u / n) low bits of each, in whole bytes; the high parts are unary in a bit vector, a one for each element and a zero after each value of
the high part. The place of each SAMPLE-th one and of each SAMPLE-th zero is kept, and the number of ones before each
block, by which long runs between two of these places are bisected; so reading an element and finding the place of a
value take a window or two of the bit vector, however the numbers cluster. All queries are vectors.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow.fs

SAMPLE = 16
BLOCK = 512
_ONE = np.uint64(1)


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_ODD, _PAIRS, _NIBBLES = np.uint64(0xAAAAAAAAAAAAAAAA), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: The place of the r-th set bit of each byte, at 256 * r + byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[r] for r in range(8) for byte in range(256)], np.uint8)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word, 64 if it has fewer: sums over bytes tell the byte, a table the bit."""
    k = np.minimum(k, 64).astype(np.uint64)
    sums = word - ((word & _ODD) >> _ONE)
    sums = (sums & _PAIRS) + ((sums >> np.uint64(2)) & _PAIRS)
    sums = ((sums + (sums >> np.uint64(4))) & _NIBBLES) * _BYTES
    missing = (sums >> np.uint64(56)) <= k
    shift = np.bitwise_count(((k * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) * np.uint64(8)
    np.minimum(shift, np.uint64(56), out=shift)
    rank = k - (((sums << np.uint64(8)) >> shift) & np.uint64(255))
    place = _IN_BYTE[((rank & np.uint64(7)) << np.uint64(8)) | ((word >> shift) & np.uint64(255))] + shift.astype(np.int64)
    place[missing] = 64
    return place


class EliasFano:
    """A rising sequence; arrays() are what it consists of."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, rank: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros, self.rank = n, low_bits, low, high, ones, zeros, rank
        self.shift = np.uint64(low_bits)
        # A window at every byte; the vector ends with enough zero bytes.
        self.windows = np.ndarray((max(len(high) - 7, 0),), "<u8", buffer=high, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, min(63, (universe // n).bit_length() - 1)) if n else 0
        shift = np.uint64(low_bits)
        values = values.astype(np.uint64)
        rest, planes = values & ((_ONE << shift) - _ONE), -(-low_bits // 8)
        low = np.stack([((rest >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8) for b in range(planes)]) if planes else np.zeros((0, n), np.uint8)
        high = (values >> shift).astype(np.int64)
        buckets = (universe >> low_bits) + 1 if n else 1
        bits = np.zeros(n + buckets + 1, dtype=np.uint8)
        ones = high + np.arange(n)
        bits[ones] = 1
        zeros = np.flatnonzero(bits == 0)
        packed = np.concatenate((np.packbits(bits, bitorder="little"), np.zeros(16, np.uint8)))
        rank = np.searchsorted(ones, np.arange(0, len(bits) + BLOCK, BLOCK)).astype(np.int64)
        return cls(n, low_bits, low, packed, ones[::SAMPLE].astype(np.int64), np.concatenate(([0], zeros[SAMPLE - 1 :: SAMPLE] + 1)).astype(np.int64), rank)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros, f"{name}.rank": self.rank}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = (int(x) for x in arrays[f"{name}.head"])
        return cls(n, low_bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros", "rank")))

    def _skip(self, at: np.ndarray, k: np.ndarray, invert: bool) -> np.ndarray:
        """The places of the k-th ones, or zeros, from the bits `at` on."""
        at, k, out, open_ = at.copy(), k.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            word = self.windows[at >> 3] >> (at & 7).astype(np.uint64)
            if invert:
                word = ~word
            valid = 64 - (at & 7)
            word &= (np.uint64(0xFFFFFFFFFFFFFFFF) >> (at & 7).astype(np.uint64))
            place = _select(word, k)
            hit = place < valid
            out[open_[hit]] = at[hit] + place[hit]
            rest = ~hit
            k = k[rest] - np.bitwise_count(word[rest]).astype(np.int64)
            at, open_ = at[rest] + valid[rest], open_[rest]
        return out

    def _select(self, sample: np.ndarray, k: np.ndarray, invert: bool) -> np.ndarray:
        """The places of the k-th ones, or zeros, of all."""
        near = k // SAMPLE
        at, rest = sample[near], k % SAMPLE
        until = np.where(near + 1 < len(sample), sample[np.minimum(near + 1, len(sample) - 1)], (len(self.rank) - 1) * BLOCK)
        if len(far := np.flatnonzero(until - at > 2 * BLOCK)):
            lo, hi, want = at[far] // BLOCK, np.minimum(until[far] // BLOCK, len(self.rank) - 1), k[far]
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                before = mid * BLOCK - self.rank[mid] if invert else self.rank[mid]
                fits = before <= want
                lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
            before = lo * BLOCK - self.rank[lo] if invert else self.rank[lo]
            jump = lo * BLOCK > at[far]
            at[far[jump]] = lo[jump] * BLOCK
            rest[far[jump]] = (want - before)[jump]
        return self._skip(at, rest, invert)

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.uint64)
        for b in range(len(self.low)):
            out |= self.low[b][index].astype(np.uint64) << np.uint64(8 * b)
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """The elements at index."""
        index = np.asarray(index, np.int64)
        place = self._select(self.ones, index, False)
        return ((place - index).astype(np.uint64) << self.shift) | self._low(index)

    def pairs(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at index and those after them; the second ones' bits are mostly in the word after the first ones'."""
        index = np.asarray(index, np.int64)
        place = self._select(self.ones, index, False)
        at = place + 1
        word = self.windows[at >> 3] >> (at & 7).astype(np.uint64)
        after = at + np.bitwise_count((word & (~word + _ONE)) - _ONE)
        if len(far := np.flatnonzero(word == 0)):
            after[far] = self._select(self.ones, index[far] + 1, False)
        return ((place - index).astype(np.uint64) << self.shift) | self._low(index), ((after - index - 1).astype(np.uint64) << self.shift) | self._low(index + 1)

    def find(self, values: np.ndarray, most: int | None = None) -> np.ndarray:
        """The index of each value, -1 for those that the sequence hasn't, -2 for those not met among the first `most` elements
        with their high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> self.shift).astype(np.int64)
        inside = np.flatnonzero(high // SAMPLE < len(self.zeros))
        high, low = high[inside], values[inside] & ((_ONE << self.shift) - _ONE)
        at = np.zeros(len(high), np.int64)
        more = np.flatnonzero(high)
        at[more] = self._select(self.zeros, high[more] - 1, True) + 1
        open_, looked = np.arange(len(inside)), 0
        while len(open_):
            bit = (self.high[at[open_] >> 3] >> (at[open_] & 7).astype(np.uint8)) & 1
            open_ = open_[bit == 1]
            if looked == most:
                out[inside[open_]] = -2
                break
            looked += 1
            index = at[open_] - high[open_]
            same = self._low(index) == low[open_]
            out[inside[open_[same]]] = index[same]
            open_ = open_[~same]
            at[open_] += 1
        return out


    def search(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The index of each value among the elements from lo to hi, which lie from low to high; -1 for none.

        The place is guessed in proportion at first and halved later, so that evenly spread elements take few steps and
        none more than a bisection.
        """
        out, open_ = np.full(len(values), -1, np.int64), np.flatnonzero(lo < hi)
        values, lo, hi, low, high = (x[open_].astype(np.int64) for x in (values, lo, hi, low, high))
        step = 0
        while len(open_):
            share = (values - low + 1) / (high - low + 2) if step < 6 else np.full(len(open_), 0.5)
            mid = np.clip(lo + ((hi - lo) * share).astype(np.int64), lo, hi - 1)
            found = self.get(mid).astype(np.int64)
            hit = found == values
            out[open_[hit]] = mid[hit]
            less = found < values
            lo, low = np.where(less, mid + 1, lo), np.where(less, found + 1, low)
            hi, high = np.where(less, hi, mid), np.where(less, high, found - 1)
            keep = ~hit & (lo < hi)
            open_, values, lo, hi, low, high = (x[keep] for x in (open_, values, lo, hi, low, high))
            step += 1
        return out


def _at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path)
    return pyarrow.fs.FileSystem.from_uri(uri)


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """The place of a new file in the folder, with the arrays one after another."""
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.level"
    head, at = {}, 0
    for key, x in arrays.items():
        head[key] = (at, x.dtype.str, x.shape)
        at += -(-x.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 8) % 64)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(len(line).to_bytes(8, "little") + line)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 64))
    return f"{folder}/{name}"


@lru_cache(4096)
def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; from a store that can't be mapped they are read."""
    system, path = _at(uri)
    # A plain view of the map: slices of numpy's own class for maps are slow.
    data = np.memmap(path, np.uint8, "r").view(np.ndarray) if isinstance(system, pyarrow.fs.LocalFileSystem) else np.frombuffer(system.open_input_file(path).read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {k: data[8 + size + at : 8 + size + at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(kind).reshape(shape) for k, (at, kind, shape) in head.items()}
