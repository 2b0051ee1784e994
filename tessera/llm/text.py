"""Vectorised tokens and shingles of Arrow text columns.

A token is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with
A-Z lower-cased. Tokens and shingles are 64-bit hashes: two of n different ones agree with a chance of about n^2 / 2^65.
Null texts count as empty. Work is done a few megabytes at a time, so that memory follows neither the batch nor a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SAME = np.arange(256, dtype=np.uint8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size in _powers:
        return _powers[size]
    up = np.full(size, BASE, dtype=np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size <= PIECE:
        _powers[size] = made
    return made


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a row above that stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _hashes(data: np.ndarray, heads: np.ndarray, gaps: np.ndarray, lower: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Their first bytes' positions, token hashes, and hashes of their prefixes, 0 for tokens that aren't longer.

    heads: where rows start, which also ends a token; gaps: which bytes stand between tokens; lower: what bytes count as.
    """
    space = gaps[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    heads = heads[heads < len(data)]
    before[heads] = True
    after[heads[heads > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = _table(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    found = [starts, mix((total[ends] - total[starts]) * down[starts])]
    for k in prefixes:
        longer = ends - starts > k
        h = np.zeros(len(starts), np.uint64)
        h[longer] = mix((total[starts[longer] + k] - total[starts[longer]]) * down[starts[longer]] ^ np.uint64(k))
        found.append(h)
    return tuple(found)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows data[at[i]:at[i+1]] in order, and the offsets of the rows' tokens."""
    return terms(data, at)[::-1]


def terms(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = _SPACE, lower: np.ndarray = _LOWER, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """The offsets of the rows' tokens, token hashes in order, and hashes of the tokens' prefixes of so many bytes (0: none)."""
    out, where, lo, end = [], [], int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + PIECE, end)
        while hi < end:
            spaces = np.flatnonzero(gaps[data[lo:hi]])
            heads = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "right")]
            cut = max(lo + int(spaces[-1]) + 1 if len(spaces) else lo, int(heads[-1]) if len(heads) else lo)
            if cut > lo:
                hi = cut
                break
            hi = min(hi + PIECE, end)
        i, j = np.searchsorted(at, [lo, hi])
        starts, *found = _hashes(data[lo:hi], at[i:j] - lo, gaps, lower, prefixes)
        out.append(found)
        where.append(starts + lo)
        lo = hi
    if not out:
        return np.zeros(len(at), np.int64), *[np.zeros(0, np.uint64)] * (1 + len(prefixes))
    return np.searchsorted(np.concatenate(where), at).astype(np.int64), *[np.concatenate(x) for x in zip(*out, strict=True)]


def shingles(words: np.ndarray, at: np.ndarray, size: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` tokens in each row; with `short`, a row with fewer, but some, has one run of them all.

    The second result gives the row of each.
    """
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(np.maximum(n - size + 1, 0))[:-1])), np.maximum(n - size + 1, 0)) + np.arange(len(row))
    total = np.full(len(row), size, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + words[first + k]
    total = mix(total)
    if short and len(few := np.flatnonzero((n > 0) & (n < size))):
        more = np.empty(len(few), dtype=np.uint64)
        for i, r in enumerate(few):
            h = np.full(1, n[r], dtype=np.uint64)
            for w in words[at[r] : at[r + 1]]:
                h = h * np.uint64(BASE) + w
            more[i] = mix(h)[0]
        total, row = np.concatenate((total, more)), np.concatenate((row, few))
        order = np.argsort(row, kind="stable")
        total, row = total[order], row[order]
    return total, row
