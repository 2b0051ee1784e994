"""N-gram Jaccard self-join of texts by chosen paths.

A text is the set of its five-word shingles (one of one to four words has a single shingle of them all). Equal sequences
of words are one class of copies, kept as a node with a fingerprint; only nodes are compared, so copies never multiply.

Each node is embedded as WIDTH MinHash values. In each run a node samples a few of them (three at the threshold of 0.8), and nodes that sample
one value at one place share a bucket. Two nodes of similarity s have s * WIDTH values in common, so they share
3 * s buckets in the mean. A bucket of more than SMALL nodes is split again by the values that its nodes sample below it,
until it is small or its nodes are alike: ALIKE of them have the same value at a probed place, so no value would split
it. From the fourth level on nodes sample fewer values, by which pairs at the threshold still meet with a chance that
doesn't fall with the depth, while buckets of less similar nodes shrink. Small buckets are brute-forced.

Alike buckets have pivots: the node that comes first in an order of all nodes. Buckets that hold the same cloud of nodes
mostly have the same pivot, so the many alike buckets of a cloud become a few groups, each a pivot and the nodes that
share an alike bucket with it. A group is brute-forced in pairs of blocks of at most BLOCK nodes and about BLOCK_BYTES of
shingles, each a bucket of its own, so nothing is capped and no task gets a whole group. The links of a cloud are
counted exactly, so a cloud of n different texts takes n * n / 2 comparisons of MinHash values, and n / BLOCK rows for each
of its nodes.

Runs are repeated until a pair at the threshold is missed with a chance below 1 - recall. A pair is looked at once: in the
least group that it shares; if it shares none, in the first bucket in the order of the recursion that it shares and that
isn't split. The buckets before it are known from the node's values and the list of its buckets that were split.

Brute force has two steps: pairs whose MinHash values agree too seldom go, by five standard deviations; the nodes left
get their shingles, read again from their texts, and exact similarities decide. Links are similarities of at least the
threshold. A bucket returns how many links each node has in it and a spanning forest of them, not the pairs; classes are
the connected components of the forests.

Null and empty texts are copies of each other and have no links to others. Rows with a null key are no part of the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.frames import column, steps, with_arrays
from tessera.llm.store import discard, written
from tessera.llm.text import chunks, mix, raw, shingles, tokens

THRESHOLD = 0.8
RECALL = 0.9999
WIDTH = 128
#: Values common to a pair at the threshold that it samples in the mean, at the first levels and at those below them.
FIRST, LATER, FIRST_LEVELS = 2.4, 1.4, 3
SMALL = 48
BLOCK = 1024
BLOCK_BYTES = 16 << 20
ALIKE = 0.5
PAIRS = 1 << 16
#: Rows of a bucket or group from which it is hot: its rows aren't dealt by it. At most SENT_HOT hot ones are sent to executors.
HOT, SENT_HOT = 2048, 100_000
#: Nodes whose keys are sent to all executors to find their texts; for more of them texts are joined by key.
SENT_KEYS = 500_000

_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = _SEEDS.astype(np.uint32)


def branches(level: int, threshold: float) -> float:
    """How many of its values a node samples at a level in the mean."""
    return min(WIDTH, (FIRST if level <= FIRST_LEVELS else LATER) / threshold)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold shares a leaf bucket with the chance `recall`, however deep it is."""
    met = 1.0
    for level in (*[FIRST_LEVELS + 1] * 200, *range(FIRST_LEVELS, 0, -1)):
        met = 1 - (1 - met * branches(level, threshold) / WIDTH) ** (threshold * WIDTH)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def signature(values: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingles."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 4096):
        x = low[lo : lo + 4096, None] * _ODD + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def fingerprints(words: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits for the sequence of each row's tokens."""
    n = np.diff(ends)
    place = np.arange(len(words)) - np.repeat(ends[:-1], n)
    up = np.cumprod(np.full(int(n.max(initial=0)) + 1, 0xC6BC279692B5CC83 | 1, dtype=np.uint64))
    total = np.zeros((len(n), 2), np.uint64)
    for k, salt in enumerate((0, 0xA24BAED4963EE407)):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ np.uint64(salt)) * up[place], out=sums[1:])
        total[:, k] = sums[ends[1:]] - sums[ends[:-1]]
    total[:, 1] ^= mix(n.astype(np.uint64))
    return [x.tobytes() for x in total]


def _sets(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Fingerprints and sorted distinct shingles of rows, some at a time."""
    for lo, hi in chunks(at):
        words, ends = tokens(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        values, row = shingles(words, ends)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        yield fingerprints(words, ends), [np.unique(values[edges[i] : edges[i + 1]]) for i in range(hi - lo)]


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp, sig (null for rows without words) and size, the number of shingles."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())

    def compute(batch: pa.RecordBatch) -> list:
        marks, sigs, sizes = [], [], []
        for fps, sets in _sets(*raw(batch.column(1))):
            marks += fps
            sigs += [signature(s).tobytes() if len(s) else None for s in sets]
            sizes += map(len, sets)
        return [pa.array(marks, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]

    return with_arrays(docs, compute, [T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())], ("text",))


def _matrix(column: pa.Array) -> np.ndarray:
    """The MinHash values of a column of signatures."""
    data, _ = raw(column)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(len(column), WIDTH)


def _chosen(sigs: np.ndarray, salt: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Which values are sampled below a salt, `rate` of a node's in the mean, and the keys of the buckets that they lead to."""
    place = np.arange(1, WIDTH + 1, dtype=np.uint64) << np.uint64(32)
    keys = mix((sigs.astype(np.uint64) | place) ^ salt[:, None])
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) < np.uint64(min(int(rate * 2**64) // WIDTH, 2**64 - 1)), keys


def _run_salts(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))


def _top(nodes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """fp, bucket and probe of each bucket at the top; probe: the node's value at a place that the bucket's key gives."""
    salts = _run_salts(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1 << 20):
            sigs = _matrix(batch.column(1))
            for salt in salts:
                on, keys = _chosen(sigs, np.full(len(sigs), salt), branches(1, threshold))
                row, _ = np.nonzero(on)
                yield _bucketed(batch, sigs, row, keys[on])

    return nodes.select("fp", "sig").mapInArrow(run, "fp binary, bucket long, probe long")


def _bucketed(batch: pa.RecordBatch, sigs: np.ndarray, row: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    probe = sigs[row, (mix(keys) % np.uint64(WIDTH)).astype(np.int64)].astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys.astype(np.int64)), pa.array(probe)], names=["fp", "bucket", "probe"])


def _below(large: DataFrame, level: int, threshold: float) -> DataFrame:
    """fp, bucket and probe of the buckets of `level`, one below those of large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1 << 20):
            sigs = _matrix(batch.column(1))
            on, keys = _chosen(sigs, batch.column(2).to_numpy().astype(np.uint64), branches(level, threshold))
            yield _bucketed(batch, sigs, np.nonzero(on)[0], keys[on])

    return large.select("fp", "sig", "bucket").mapInArrow(run, "fp binary, bucket long, probe long")


def _met(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table, which has one row for each key and the number n of its rows; hot keys stay where they are."""
    hot = table.filter(F.col("n") > HOT)
    if not 0 < hot.count() <= SENT_HOT:
        return rows.join(table.hint("merge"), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("n") <= HOT).hint("merge"), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _leaves(nodes: DataFrame, runs: int, threshold: float) -> tuple[DataFrame, int]:
    """The nodes in leaf buckets and in blocks of groups, and the number of levels: fp, sig, size, bucket, home, side,
    grouped, splits and groups.

    home: the group of which this bucket is a pair of blocks (then grouped), or the bucket itself; splits: the node's buckets
    that were split; groups: its groups. Pairs in a bucket are of different sides where these aren't 0.
    """
    found, level = written(_top(nodes, runs, threshold), "paths"), 1
    rows_out, splits, grouped = [], [], []
    while True:
        sizes = written(found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        sized = written(_met(found, sizes, "bucket"), "sized")
        for table in (found, sizes):
            discard(table)
        rows_out.append(sized.filter(F.col("n") <= SMALL).select("fp", "bucket", F.col("bucket").alias("home"), F.lit(0).alias("side"), F.lit(False).alias("grouped")))
        big = sized.filter(F.col("n") > SMALL)
        if not big.head(1):
            break
        first = F.min(F.struct(F.xxhash64("fp").alias("place"), "fp")).alias("first")
        kinds = big.groupBy("bucket", "probe").agg(F.count("*").alias("c"), first).groupBy("bucket").agg(F.max("c").alias("mode"), F.sum("c").alias("n"), F.min("first").alias("first"))
        kinds = written(kinds.select("bucket", "n", (F.col("mode") >= ALIKE * F.col("n")).alias("alike"), F.xxhash64("first.fp", F.lit("pivot")).alias("group")), "kinds")
        told = written(_met(big.select("fp", "bucket"), kinds, "bucket").select("fp", "bucket", "alike", "group"), "told")
        discard(kinds)
        grouped.append(told.filter("alike").select("fp", "group"))
        split = told.filter("NOT alike").select("fp", "bucket")
        if not split.head(1):
            break
        splits.append(split)
        level += 1
        found = written(_below(split.join(nodes.hint("merge").select("fp", "sig"), "fp"), level, threshold), "paths")
    none = nodes.select("fp", F.lit(0).cast("long").alias("x"), F.lit(0).alias("kind")).limit(0)
    lists = [none, *[x.select("fp", F.col("bucket").alias("x"), F.lit(1).alias("kind")) for x in splits]]
    if grouped:
        groups = reduce(DataFrame.unionAll, grouped).distinct().join(nodes.hint("merge").select("fp", "size"), "fp")
        groups = written(groups, "groups")
        lists.append(groups.select("fp", F.col("group").alias("x"), F.lit(2).alias("kind")))
        sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("total") / BLOCK_BYTES)).cast("int")
        sizes = written(sizes.select("group", "n", parts.alias("parts")), "sizes")
        whole = _met(groups.select("fp", "group"), sizes, "group")
        whole = whole.select("fp", "group", F.pmod(F.xxhash64("fp", F.lit("part")), "parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        block = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"), F.lit("block"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        rows_out.append(whole.select("fp", block.alias("bucket"), F.col("group").alias("home"), side.alias("side"), F.lit(True).alias("grouped")))
    one = [F.collect_list(F.when(F.col("kind") == k, F.col("x"))).alias(name) for k, name in ((1, "splits"), (2, "groups"))]
    lists = reduce(DataFrame.unionAll, lists).groupBy("fp").agg(*one)
    own = written(nodes.select("fp", "sig", "size").join(lists.hint("merge"), "fp", "left"), "own")
    rows = reduce(DataFrame.unionAll, rows_out)
    return rows.join(own.hint("merge"), "fp").select("fp", "sig", "size", "bucket", "home", "side", "grouped", "splits", "groups"), level


def _groups(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows again, such that each batch ends with the end of a run of equal values in the column `at`, after BLOCK
    rows or, where a run is longer, with that run."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(at).to_numpy()
        if not len(keys):
            continue
        if rest and rest[-1].column(at)[-1].as_py() != keys[0]:
            yield _one(rest)
            rest = []
        lo, ends = 0, (np.flatnonzero(np.diff(keys)) + 1).tolist()
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - lo > BLOCK:
                yield _one([*rest, batch.slice(lo, end - lo)])
                rest, lo = [], end
        rest.append(batch.slice(lo))
    if rest:
        yield _one(rest)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.concat_batches(batches)


def _pairs(bucket: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within runs of a bucket, some at a time."""
    n = len(bucket)
    end = np.searchsorted(np.flatnonzero(np.diff(bucket)) + 1, np.arange(n), "right")
    ends = np.concatenate((np.flatnonzero(np.diff(bucket)) + 1, [n]))[end]
    count = ends - np.arange(n) - 1
    total = np.cumsum(count)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
        ok = (side[i] == 0) | (side[i] != side[j])
        yield i[ok], j[ok]
        lo = hi


def _paths(sigs: np.ndarray, split: np.ndarray, salts: np.ndarray, depth: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each node the buckets that it is in and that aren't split, in the order of the recursion: their keys, and the
    places of the values sampled on the way, `depth` for each (the last repeated)."""
    on, keys = (np.concatenate(x, axis=1) for x in zip(*[_chosen(sigs, np.full(len(sigs), salt), branches(1, threshold)) for salt in salts], strict=True))
    row, col = np.nonzero(on)
    key, order, places = keys[on], col[:, None], (col % WIDTH)[:, None]
    done = []
    for level in range(1, depth + 1):
        open_ = np.isin(key, split) if level < depth and len(split) else np.zeros(len(key), dtype=bool)
        pad = [(0, 0), (0, depth - level)]
        done.append((row[~open_], key[~open_], np.pad(order[~open_], pad, constant_values=-1), np.pad(places[~open_], pad, mode="edge")))
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        on, keys = _chosen(sigs[row[at]], key[at], branches(level + 1, threshold))
        parent, col = np.nonzero(on)
        at = at[parent]
        row, key = row[at], keys[on]
        order, places = np.column_stack((order[at], col)), np.column_stack((places[at], col))
    row, key, order, places = (np.concatenate(x) for x in zip(*done, strict=True))
    first = np.lexsort((*order.T[::-1], row))
    row, key, places = row[first], key[first], places[first]
    edges = np.searchsorted(row, np.arange(len(sigs) + 1))
    return [(key[lo:hi], places[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _lists(column: pa.Array, pad: int) -> np.ndarray:
    """The sorted values of each row's list, as rows of a matrix filled up with pad."""
    at = np.concatenate(([0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
    n, values = np.diff(at), column.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    out = np.full((len(n), max(1, int(n.max(initial=0)))), pad)
    out[row, np.arange(len(values)) - at[row]] = values[np.lexsort((values, row))]
    return out


def _here(groups: pa.Array, i: np.ndarray, j: np.ndarray, home: np.ndarray, grouped: np.ndarray) -> np.ndarray:
    """Which pairs belong to their bucket as far as groups tell: those whose least common group it is of, or that have none."""
    of_i, of_j = _lists(groups, np.iinfo(np.int64).min), _lists(groups, np.iinfo(np.int64).max)
    here, step = np.zeros(len(i), dtype=bool), max(1, (1 << 21) // of_i.shape[1] ** 2)
    for lo in range(0, len(i), step):
        a, own = of_i[i[lo : lo + step]], home[i[lo : lo + step]]
        common = (a[:, :, None] == of_j[j[lo : lo + step]][:, None, :]).any(axis=2)
        least = a[np.arange(len(a)), common.argmax(axis=1)]
        here[lo : lo + step] = np.where(grouped[i[lo : lo + step]], least == own, ~common.any(axis=1))
    return here


def _candidates(batch: pa.RecordBatch, salts: np.ndarray, depth: int, least: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a batch of leaves that agree often enough, are of sizes near enough, and belong to this bucket."""
    sigs, size, bucket, home, side = _matrix(batch.column(1)), *[batch.column(k).to_numpy() for k in (2, 3, 4, 5)]
    grouped, split = batch.column(6).to_numpy(zero_copy_only=False), np.unique(batch.column(7).flatten().to_numpy().astype(np.uint64))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    need = least * WIDTH
    for i, j in _pairs(bucket, side):
        near = np.minimum(size[i], size[j]) >= (threshold - 1e-9) * np.maximum(size[i], size[j])
        i, j = i[near], j[near]
        agree = np.zeros(len(i), np.int64)
        for lo in range(0, len(i), 8192):
            agree[lo : lo + 8192] = (sigs[i[lo : lo + 8192]] == sigs[j[lo : lo + 8192]]).sum(axis=1)
        i, j = i[agree >= need], j[agree >= need]
        here = _here(batch.column(8), i, j, home, grouped)
        i, j = i[here], j[here]
        out.append((i[grouped[i]], j[grouped[i]]))
        i, j = i[~grouped[i]], j[~grouped[i]]
        rows, number = np.unique(i, return_inverse=True)
        for lo, hi in chunks(np.arange(0, len(rows) + 1), 128):
            edges = np.searchsorted(number, np.arange(lo, hi + 1))
            for k, (keys, places) in enumerate(_paths(sigs[rows[lo:hi]], split, salts, depth, threshold)):
                row, to = rows[lo + k], j[edges[k] : edges[k + 1]]
                before = places[: int(np.argmax(keys == home[row].astype(np.uint64)))]
                for some in (before[:3], before[3:]):
                    if len(some) and len(to):
                        same = sigs[to] == sigs[row]
                        to = to[~same[:, some].all(axis=2).any(axis=1)]
                out.append((np.full(len(to), row), to))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _kept(leaves: DataFrame, salts: np.ndarray, depth: int, least: float, threshold: float) -> DataFrame:
    """The rows of leaf buckets that have a candidate in theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            i, j = _candidates(batch, salts, depth, least, threshold)
            yield batch.take(pa.array(np.unique(np.concatenate((i, j)))))

    ordered = leaves.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return ordered.mapInArrow(run, leaves.schema)


def _links(kept: DataFrame, salts: np.ndarray, depth: int, least: float, threshold: float) -> DataFrame:
    """a, b and n for each node with links in a bucket: b is the node that stands for its part of the bucket's links, n
    the number of its links there. kept: leaves with the shingles of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            i, j = _candidates(batch, salts, depth, least, threshold)
            order, bucket = np.lexsort((j, i)), batch.column(3).to_numpy()
            i, j = i[order], j[order]
            data, at = raw(batch.column(9))
            values, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
            shared = np.zeros(len(i), np.int64)
            for lo, hi in _spans(bucket[i]):
                first, last = int(i[lo:hi].min()), int(j[lo:hi].max()) + 1
                own = values[at[first] : at[last]]
                number = np.unique(own, return_inverse=True)[1]
                heads, mark = at[first:last] - at[first], np.zeros(int(number.max()) + 1, dtype=bool)
                for s, e in _spans(i[lo:hi]):
                    a = int(i[lo + s]) - first
                    mine = number[heads[a] : at[first + a + 1] - at[first]]
                    mark[mine] = True
                    to = j[lo + s : lo + e] - first
                    low = int(to.min())
                    sums = np.add.reduceat(mark[number[heads[low] :]].astype(np.int64), heads[low:] - heads[low])
                    shared[lo + s : lo + e] = sums[to - low]
                    mark[mine] = False
            size = np.diff(at)
            similar = shared / np.maximum(size[i] + size[j] - shared, 1)
            good = similar >= threshold - 1e-12
            i, j = i[good], j[good]
            n = np.bincount(np.concatenate((i, j)), minlength=batch.num_rows)
            stands = _forest(i, j, batch.num_rows)
            has, fp = np.flatnonzero(n), batch.column(0)
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(has)), fp.take(pa.array(stands[has])), pa.array(n[has])], names=["a", "b", "n"])

    ordered = kept.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return ordered.mapInArrow(run, "a binary, b binary, n long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place in the component of each place under the edges (i, j)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, least[i], low)
        np.minimum.at(after, least[j], low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def _spans(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values."""
    if len(values):
        edges = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


def _shingled(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """fp and the packed shingles of the wanted nodes, from the text of the least key of each."""
    keys = wanted.join(nodes.select("fp", "id").hint("merge"), "fp").select("id", "fp")
    keys = written(keys, "wanted")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    few = keys.count() <= SENT_KEYS
    texts = texts.join(F.broadcast(keys) if few else keys.hint("merge"), "id")

    def compute(batch: pa.RecordBatch) -> list:
        found = []
        wanted = batch.column(at_fp).to_pylist()
        for marks, sets in _sets(*raw(batch.column(at_text))):
            # Of rows that repeat a key only those with the node's own text count.
            found += [s.tobytes() if m == wanted[len(found) + k] else None for k, (m, s) in enumerate(zip(marks, sets, strict=True))]
        return [pa.array(found, pa.binary())]

    at_fp, at_text = column(texts, "fp"), column(texts, "text")
    made = with_arrays(texts, compute, [T.StructField("shingles", T.BinaryType())], ("text", "id"))
    return written(made.filter(F.col("shingles").isNotNull()).dropDuplicates(["fp"]), "shingles")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """key, fp (its node), class_id (the least key of its class) and n_links (the number of other nodes that the row's node
    is linked to) for each row of docs with a key."""
    salts = _run_salts(runs := runs_for(recall, threshold))
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / WIDTH)
    signed = written(_signed(docs, key, text), "signed")
    nodes = written(signed.groupBy("fp").agg(F.min("id").alias("id"), F.first("sig", ignorenulls=True).alias("sig"), F.max("size").alias("size")), "nodes")
    leaves, depth = _leaves(nodes.filter(F.col("sig").isNotNull()), runs, threshold)
    kept = written(_kept(leaves, salts, depth, least, threshold), "kept")
    sets = _shingled(docs, nodes, kept.select("fp").distinct(), key, text)
    links = written(_links(kept.join(sets.hint("merge"), "fp").select(*kept.columns, "shingles"), salts, depth, least, threshold), "links")
    roots = components(links)
    degree = links.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    linked = written(roots.withColumnRenamed("node", "fp").join(nodes.select("fp", "id").hint("merge"), "fp"), "linked")
    least_id = written(linked.groupBy("root").agg(F.min("id").alias("class_id")), "roots")
    classes = linked.join(least_id.hint("merge"), "root").select("fp", "class_id").join(degree.hint("merge"), "fp")
    table = nodes.select("fp", "id").join(classes.hint("merge"), "fp", "left")
    table = written(table.select("fp", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    return signed.select(F.col("id").alias(key), "fp").join(table.hint("merge"), "fp").select(key, "fp", "class_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs whose key is the least of its class; of rows that repeat key and text one stays, and rows with a null
    key all stay."""
    rows = join(docs, key, text, threshold, recall)
    gone = rows.filter(F.col(key) != F.col("class_id")).select(key).distinct()
    kept = docs.join(written(gone, "gone").hint("merge"), key, "left_anti").select(*docs.columns)
    if not rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").head(1):
        return kept
    return kept.filter(F.col(key).isNotNull()).dropDuplicates([key, text]).unionByName(kept.filter(F.col(key).isNull()))
