"""Best-fit packing of tokenised documents into sequences by linear grouping.

A document's tokens and an end token are one piece, or, if longer than a sequence, pieces of a sequence's length of which
the first is shorter by what is missing. Pieces of full length are sequences. Of the others, those above SMALL are large:
by length they are cut into groups of as many pieces each, every length counts as the largest of its group, and
configurations of these few sizes that need the fewest sequences are found by column generation (a knapsack over the
prices of sizes finds each new one); their multiples are rounded down and the rest is packed first-fit by size. Actual
pieces take the places of their group's size. Then small ones, the longest first, go where they leave the least room.

Lengths are whole numbers up to a sequence's, so the plan needs only how many pieces have each length and how many
sequences have each number of free places: tables of at most that many rows, and these alone reach the driver. A plan
says which places among the pieces of one length go to which sequences; pieces get their places among those of their
length as `numbered` gives them, so no length is ever gathered in one task.

Null and empty texts are one end token. Rows with equal keys are documents of their own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import read_ranks
from tessera.llm.frames import bounded, column, steps
from tessera.llm.numbering import numbered
from tessera.llm.store import written

CAPACITY = 1024
END = 2
#: Lengths up to this are packed after the others; groups that the others form.
SMALL, GROUPS = 256, 96
BATCH_BYTES = 4 << 20
#: Characters of a text that are encoded at once, if it has a place to cut it.
SEGMENT = 1 << 20
CUT = re.compile(r"\S(?= \S)")
#: What the two encoders might tell apart or be slow at.
RARE = re.compile(r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e]|\S{400}|\s{400}")
_coders: dict[tuple, Coder] = {}


class Coder:
    """The ids of one vocabulary as the tokenizers library gives them; names of special tokens are ordinary text.

    Texts of common characters without very long runs, which is almost all, are encoded by the ranks of the same vocabulary,
    which is three times as fast; the rest by the tokenizer itself. Long texts are encoded in segments, cut before a space that stands between
    two other characters, as no pre-token reaches over such a place.
    """

    def __init__(self, tokenizer: str, ranks: dict[bytes, int], pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.ranked = Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def segments(text: str) -> Iterator[str]:
        lo = 0
        while len(text) - lo > SEGMENT and (at := CUT.search(text, lo + SEGMENT)):
            yield text[lo : at.start() + 1]
            lo = at.start() + 1
        yield text[lo:]

    def _ids(self, text: str) -> np.ndarray:
        if RARE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return b"".join(self._ids(x).tobytes() for x in self.segments(text))


def _coder(shared, pattern: str) -> Coder:
    """This worker's coder of a broadcast vocabulary."""
    key = (id(shared.value), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(*shared.value, pattern)
    return _coders[key]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each document's pieces; with `ids` their packed ids too.

    tokenizer, ranks: a byte-level vocabulary as a file of the tokenizers library and as a .tiktoken file; pattern: that of its
    pre-tokens. The driver reads both; their bytes are the bound of what is broadcast.
    """
    bounded(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), read_ranks(ranks)))
    rows = docs.select(key, text)
    fields = [docs.schema[key], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    fields.insert(1, T.StructField("piece", T.IntegerType()))
    fields += [T.StructField("ids", T.BinaryType())] * ids
    names, last = [f.name for f in fields], np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, BATCH_BYTES):
            coder = _coder(shared, pattern)
            packed = [coder.encode(x or "") + last for x in batch.column(1).to_pylist()]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            n = -(-counts // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = counts - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[of], capacity)
            parts = [memoryview(packed[i])[4 * a : 4 * (a + k)] for i, a, k in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in parts], pa.binary())] * ids, names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each configuration (a column: how many of each size, from small to large) is used, as a fraction, for the fewest sequences."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    uses = counts / np.diag(basis)
    for _ in range(40 * k):
        prices = np.maximum(np.linalg.solve(basis.T, np.ones(k)), 0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            m = int(np.searchsorted(sizes, c, "right"))
            value = best[c - sizes[:m]] + prices[:m]
            i = int(value.argmax())
            if value[i] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[i], i
            else:
                best[c], pick[c] = best[c - 1], -1
        if best[-1] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= int(sizes[pick[c]])
        change = np.linalg.solve(basis, new)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, uses / change, np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * change, 0)
        uses[out] = ratio[out]
        basis[:, out] = new
    return basis.astype(np.int64), uses


def large_plan(counts: dict[int, int], capacity: int, groups: int, base: int) -> tuple[list[tuple], int]:
    """(length, lo, hi, first, each, sequence): places lo to hi among the pieces of a length go, `each` of them together and counted
    from `first`, to sequences from `sequence` on. And the next free number of a sequence."""
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return [], base
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    cum = np.concatenate(([0], np.cumsum(n)))
    total = int(cum[-1])
    edges = np.unique(np.arange(groups + 1) * total // groups)
    tops = lengths[np.searchsorted(cum, edges[1:], "left") - 1]
    sizes = np.unique(tops)  # groups of one size are one
    ends = np.array([edges[1:][tops == s].max() for s in sizes])
    starts = np.concatenate(([0], ends[:-1]))
    demand = ends - starts
    basis, uses = configurations(sizes, demand.astype(float), capacity)
    times = np.floor(uses + 1e-9).astype(np.int64)
    chosen = [(basis[:, j], int(times[j])) for j in np.argsort(-times, kind="stable") if times[j]]
    left = np.maximum(demand - sum((a * x for a, x in chosen), np.zeros(len(sizes), np.int64)), 0)
    open_bins: list[tuple[int, np.ndarray]] = []
    for g in range(len(sizes) - 1, -1, -1):  # the rest, a few of each size at most
        for _ in range(int(left[g])):
            i = next((i for i, (room, _) in enumerate(open_bins) if room >= sizes[g]), None)
            room, has = open_bins[i] if i is not None else (capacity, np.zeros(len(sizes), np.int64))
            has[g] += 1
            if i is None:
                open_bins.append((room - int(sizes[g]), has))
            else:
                open_bins[i] = (room - int(sizes[g]), has)
    chosen += [(has, 1) for _, has in open_bins]
    plan, at = [], starts.copy()
    for a, x in chosen:
        for g in np.flatnonzero(a):
            lo, hi = int(at[g]), int(min(at[g] + a[g] * x, ends[g]))
            at[g] = hi
            for i in range(int(np.searchsorted(cum, lo, "right")) - 1, int(np.searchsorted(cum, hi, "left"))):
                b, c = max(lo, int(cum[i])), min(hi, int(cum[i + 1]))
                if b < c:
                    plan.append((int(lengths[i]), b - int(cum[i]), c - int(cum[i]), lo - int(cum[i]), int(a[g]), base))
        base += x
    return plan, base


def small_plan(counts: dict[int, int], free: dict[int, int], capacity: int) -> list[tuple]:
    """(length, lo, hi, first, each, room, sequence): as in large_plan, with sequences numbered among those that had `room` free places;
    those with a room of `capacity` are new. Each piece, the longest first, goes to a sequence with the least room that it fits into."""
    rooms: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in free.items() if n}
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                more = -(-(n - done) // (capacity // length))
                rooms[room := capacity] = [(capacity, opened, more)]
                opened += more
            of, at, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // length
            full = min(many, (n - done) // each)
            rest = min(n - done - full * each, each) if full < many else 0
            used = full + (rest > 0)
            plan.append((length, done, done + full * each + rest, done, each, of, at))
            for held, lo, hi in ((each, at, at + full), (rest, at + full, at + used), (0, at + used, at + many)):
                if lo < hi:
                    rooms.setdefault(room - held * length, []).append((of, lo, hi - lo))
            done += full * each + rest
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """items (length, at most `capacity`, and any other columns) with sequence_id and offset, its place there."""
    spark = items.sparkSession
    placed = written(numbered(items, ["length"], [], "_place", "_size"), "items")
    counts = {r[0]: r[1] for r in placed.groupBy("length").count().collect()}
    whole = counts.get(capacity, 0)
    plan, used = large_plan({x: n for x, n in counts.items() if small < x < capacity}, capacity, groups, whole)
    plan += [(capacity, 0, whole, 0, 1, 0)] * (whole > 0)
    schema = "_length long, _lo long, _hi long, _first long, _each long, _base long"
    spot = (F.col("length") == F.col("_length")) & (F.col("_place") >= F.col("_lo")) & (F.col("_place") < F.col("_hi"))
    nth = F.col("_base") + F.expr("(_place - _first) div _each")
    large = placed.filter(F.col("length") > small).join(F.broadcast(spark.createDataFrame(plan, schema)), spot).select(*items.columns, nth.alias("sequence_id"))
    large = written(large, "large")
    room = large.filter(F.col("length") < capacity).groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))
    room = written(numbered(room, ["room"], [], "_nth", "_rooms"), "room")
    free = {r[0]: r[1] for r in room.filter("room > 0").groupBy("room").count().collect()}
    later = small_plan({x: n for x, n in counts.items() if x <= small}, free, capacity)
    little = placed.filter(F.col("length") <= small).join(F.broadcast(spark.createDataFrame(later, schema.replace("_base", "_room long, _base"))), spot).select(*items.columns, "_room", nth.alias("_seat"))
    known = little.join(room.select(F.col("room").alias("_room"), F.col("_nth").alias("_seat"), "sequence_id"), ["_room", "_seat"], "left")
    rows = large.unionByName(known.select(*items.columns, F.coalesce("sequence_id", F.col("_seat") + used).alias("sequence_id")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), *[c for c in items.columns if c != "length"]).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)))


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and the packed ids of each sequence, from pieces that carry theirs; a sequence holds no more pieces than tokens."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", ids))), lambda x: x[ids])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias(ids))
