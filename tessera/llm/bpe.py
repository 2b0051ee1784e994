"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of the pre-tokens to encode, a few megabytes of text at a time, form one linked list with a stop between
pre-tokens. Each adjacent pair that the vocabulary has as one token waits by position in the bucket of its merge rank;
a bitmap of two levels tells which buckets hold something, so the next rank is two find-first-set steps away. All
positions of a bucket are merged at once: those whose pair has changed since are stale and skipped, and of pairs that
overlap the leftmost goes first. Where a merge could make a pair of a lower rank, one position of each pre-token is
merged and the rest go back. Each merge makes at most two entries, so a pre-token of n bytes takes O(n log n) however
long it is, where a rescan for each merge takes O(n^2).

Nulls and empty texts have no tokens. Ids are held packed, as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import column, with_arrays

MEMO_ENTRIES = 300_000
BATCH_BYTES = 3 << 20
MEMO_BYTES = 48
_SHIFT = 8
_MASK = (1 << _SHIFT) - 1
_made: dict[tuple[int, int, str], Bpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The token of each line of a .tiktoken file, in base64, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class RankQueue:
    """Arrays of positions by rank, the least rank first."""

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put each position into the bucket of its rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        ends = [*heads[1:].tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[heads].tolist(), heads.tolist(), ends, strict=True):
            if rank in self.buckets:
                self.buckets[rank].append(positions[lo:hi])
                continue
            self.buckets[rank] = [positions[lo:hi]]
            high = rank >> _SHIFT
            self.words[high] = self.words.get(high, 0) | 1 << (rank & _MASK)
            self.top |= 1 << high

    def pop(self) -> tuple[int, np.ndarray]:
        """The least rank and what its bucket holds."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        rank = high << _SHIFT | (word & -word).bit_length() - 1
        self.words[high] = word = word & word - 1
        if not word:
            self.top &= self.top - 1
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class Bpe:
    """Encoder and decoder of one vocabulary. Between batches it remembers MEMO_ENTRIES words or those of one batch."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        # Under the common pattern a space before another character than white space starts a pre-token.
        self.plain = pattern.endswith(r"|\s+(?!\S)|\s+") and r"| ?[^\s\p{L}\p{N}]+" in pattern
        self.odd_space = regex.compile(r" (?!\S)").search
        self.split_space = regex.compile(r" (?=\S)").split
        self.memo: dict[str, bytes] = {}
        by_rank = sorted((r, t) for t, r in ranks.items())
        size = by_rank[-1][0] + 1 if by_rank else 0
        self.lengths = np.zeros(size, np.int64)
        self.lengths[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # Pairs of tokens that are one token together, by left id and right id; and the ranks whose token begins or
        # ends a token of a lower rank, so that their merge could make a pair that comes first.
        self.base = size + 1
        pairs, self.risky = {}, set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                head, tail = ranks.get(token[:cut]), ranks.get(token[cut:])
                if head is not None and tail is not None:
                    pairs[(head + 1) * self.base + tail + 1] = rank
                self.risky.update(x for x in (head, tail) if x is not None and x > rank)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()] or [0], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, -1 for none; the id -1 has no pairs."""
        keys = (left + 1) * self.base + right + 1
        place = np.searchsorted(self.pair_keys, keys)
        place[place == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[place] == keys, self.pair_ranks[place], -1) if len(self.pair_keys) else np.full(len(keys), -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens that aren't one token."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        stops = np.concatenate(([0], np.cumsum(sizes + 1)))
        n = int(stops[-1]) + 1
        real = np.ones(n, dtype=bool)
        real[stops] = False
        ids = np.full(n, -1, np.int64)
        ids[real] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[-1] = n - 1
        rank_at = self.pair(ids, ids[right])
        rank_at[-1] = -1
        queue, waiting = RankQueue(), np.flatnonzero(rank_at >= 0)
        queue.push(rank_at[waiting], waiting)
        while queue.top:
            rank, at = queue.pop()
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                if rank in self.risky:
                    piece = np.searchsorted(stops, at)
                    first = np.diff(piece, prepend=-1) != 0
                    if not first.all():
                        queue.push(rank_at[at[~first]], at[~first])
                    at = at[first]
                else:
                    joined = np.zeros(len(at), dtype=bool)
                    joined[1:] = right[at[:-1]] == at[1:]
                    if joined.any():
                        place = np.arange(len(at))
                        at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            gone = right[at]
            after = right[gone]
            right[at] = after
            left[after] = at
            ids[at] = rank
            real[gone] = False
            rank_at[gone] = -1
            changed = np.concatenate((left[at], at))
            changed = changed[real[changed]]
            fresh = self.pair(ids[changed], ids[right[changed]])
            rank_at[changed] = fresh
            use = fresh >= 0
            queue.push(fresh[use], changed[use])
        packed = ids[real].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(real, stops[:-1])) * 4 if len(pieces) else []
        return [packed[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(pieces) else []

    def learn(self, words: set[str], before: str = "") -> dict[str, bytes]:
        """The packed ids of words, each with `before` in front of it."""
        found, unknown = {w: self.find(before + w) for w in words}, {}
        for pieces in found.values():
            for p in pieces:
                if p not in unknown:
                    whole = self.ranks.get(raw := p.encode())
                    unknown[p] = raw if whole is None else whole.to_bytes(4, "little")
        hard = [p for p in unknown if p.encode() not in self.ranks]
        for p, ids in zip(hard, self.merge([unknown[p] for p in hard]), strict=True):
            unknown[p] = ids
        for w, p in found.items():
            found[w] = unknown[p[0]] if len(p) == 1 else b"".join([unknown[x] for x in p])
        return found

    def cut(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart."""
        if not self.plain:
            return [text]
        return self.split_space(text) if self.odd_space(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts.

        A text is cut before each space that another character follows. No pre-token reaches over such a place, and
        what follows it doesn't change the matches before it: white space there keeps its last character apart.
        """
        seen, heads = set(), set()
        for text in texts:
            head, *rest = self.cut(text)
            heads.add(head)
            seen.update(rest)
        memo, first = self.memo, self.learn(heads)
        memo.update(self.learn(seen.difference(memo), " "))
        out = []
        for text in texts:
            head, *rest = self.cut(text)
            out.append(first[head] + b"".join(map(memo.__getitem__, rest)))
        if len(memo) > MEMO_ENTRIES:  # what this batch has in use stays, as frequent words are among it
            self.memo = {w: memo[w] for w in seen if len(w) <= MEMO_BYTES}
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


def _bpe(shared, pattern: str) -> Bpe:
    """This worker's Bpe of a broadcast vocabulary; tasks that a worker runs one after another share it."""
    ranks = shared.value
    key = (id(ranks), len(ranks), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(ranks, pattern)
    return _made[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """df with the packed token ids of its texts and how many there are.

    path: a .tiktoken file, read by the driver; its bytes are the bound of what is broadcast. Columns of df called as
    the new ones are replaced.
    """
    shared, at = df.sparkSession.sparkContext.broadcast(read_ranks(path)), column(df, text)

    def compute(batch: pa.RecordBatch) -> list:
        bpe = _bpe(shared, pattern)
        packed = bpe.encode([x or "" for x in batch.column(at).to_pylist()])
        return [pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())]

    return with_arrays(df, compute, [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], size=BATCH_BYTES)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that its packed ids stand for; null ids give no bytes."""
    shared, at = df.sparkSession.sparkContext.broadcast(read_ranks(path)), column(df, ids)

    def compute(batch: pa.RecordBatch) -> list:
        bpe = _bpe(shared, pattern)
        return [pa.array([bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at)], pa.binary())]

    return with_arrays(df, compute, [T.StructField(decoded, T.BinaryType())])
