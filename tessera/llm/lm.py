"""Language-model scores from an Elias-Fano n-gram trie.

Tokens are the words of a text, A-Z lower-cased, and one end; a text without words, null or empty, has the end alone.
What comes before a text's first word is an end. The first level of the trie is the vocabulary: the words' 64-bit hashes
as a rising sequence, so that a word's number is its place, and their counts. Level k has the k-grams: a k-gram is a
child of the node of its first k - 1 words, the numbers of a node's children rise, and node * V + child is one rising
sequence. A monotone sequence of pointers tells where the children of each node begin; a lookup is a successor search
among the children of the context's node. Probabilities and back-off weights are quantised to a byte each, in steps of
1 / STEPS of a decade.

Probabilities are Witten-Bell interpolated: p(w | c) = (n(c, w) + t(c) p(w | c')) / (n(c) + t(c)), with t(c) the number
of different words after c and c' the context without its first word; below all is (n(w) + 1) / (N + V + 1).

Counting: each task counts the n-grams of its part, and sends them as packed arrays to the part of a shard that their
node and a hash give. A part merges what it gets, so that the counts that all tasks have of a frequent context's n-grams meet in as
many places as its weight asks for; a shard then merges distinct n-grams only, and writes its level to a file in the shared
folder, whose place and size is all that reaches the driver. Shards are cut by the counts of their nodes, which bound the n-grams
below them, and follow the input's size; a context lies in one shard, so a shard has at most as many n-grams as its share of the
tokens or, for a single context, as there are words. Levels are mapped into memory by those who score, so neither the model nor a count is held as a whole by
anyone. An n-gram's count and the tree hold all rows learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.eliasfano import EliasFano, load, save
from tessera.llm.frames import bounded, column, steps, with_arrays
from tessera.llm.store import fresh_path, written
from tessera.llm.text import chunks, mix, raw, tokens

ORDER = 2
STEPS = 24
#: Bytes of text learned from for each shard of a level.
SHARD_BYTES = 32 << 20
#: Bytes of text that a token stands for, where shards are weighed.
TOKEN_BYTES = 6
#: Bytes of text that are looked up at once, so that each shard gets many lookups at a time.
CHUNK_BYTES = 3 << 19
#: Different n-grams that a task holds before it sends them.
HELD = 1 << 20
#: Children of a node up to which they count as few.
FEW = 6
END = mix(np.array([0x5EED], np.uint64))[0]


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 255).astype(np.uint8)


def _value(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEPS


@dataclass
class Level:
    """Files of a level by shard, the first node of each, and the first number that each parent range begins with."""

    files: list[str] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    edges: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))

    @property
    def size(self) -> int:
        return int(self.first[-1])


@dataclass
class Model:
    """levels[0] is the vocabulary; total and words are N and V."""

    order: int
    total: int
    levels: list[Level]

    @property
    def words(self) -> int:
        return self.levels[0].size


def _each(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edges):
        yield int(shard[part[0]]), part


def _range_of(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges[1:-1], values, "right") if len(edges) > 2 else np.zeros(len(values), np.int64)


def numbers(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1: unknown) and count of each word."""
    level, out, counts = model.levels[0], np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    for k, at in _each(_range_of(level.edges, hashes)):
        arrays = load(level.files[k])
        found = EliasFano.read(arrays, "keys").find(hashes[at] - level.edges[k])
        known = found >= 0
        out[at[known]] = found[known] + level.first[k]
        counts[at[known]] = arrays["counts"][found[known]]
    return out, counts


def counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of words by number."""
    level, out = model.levels[0], np.zeros(len(ids), np.int64)
    for k, at in _each(_range_of(level.first, ids)):
        out[at] = load(level.files[k])["counts"][ids[at] - level.first[k]]
    return out


def children(model: Model, depth: int, nodes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes of level depth - 1 and words, both -1 for none: the child (-1: none), its log10 probability, and the
    log10 back-off weight of the node."""
    level = model.levels[depth - 1]
    out, logs, back = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes)), np.zeros(len(nodes))
    inside = np.flatnonzero(nodes >= 0)
    for k, part in _each(_range_of(level.edges, nodes[inside].astype(np.uint64))):
        at, arrays = inside[part], load(level.files[k])
        own = nodes[at] - int(level.edges[k])
        back[at] = _value(arrays["back"][own])
        # Nodes without children have no back-off weight; the others' children lie between two pointers. Where nodes have few
        # children, the high part of a context's child leads to it, and pointers are for contexts with many.
        use = (ids[at] >= 0) & (arrays["back"][own] > 0)
        at, own = at[use], own[use]
        base, keys = own * model.words, EliasFano.read(arrays, "keys")
        found = keys.find(base + ids[at], FEW) if keys.n < FEW * len(arrays["back"]) else np.full(len(at), -2)
        many = np.flatnonzero(found == -2)
        lo, hi = (x.astype(np.int64) for x in EliasFano.read(arrays, "pointers").pairs(own[many]))
        found[many] = keys.search(base[many] + ids[at[many]], lo, hi, base[many], base[many] + model.words - 1)
        hit = found >= 0
        out[at[hit]] = found[hit] + level.first[k]
        logs[at[hit]] = _value(arrays["logs"][found[hit]])
    return out, logs, back


def _last_words(model: Model, depth: int, nodes: np.ndarray) -> np.ndarray:
    """The last word of each node of a level."""
    if depth == 1:
        return nodes
    level, out = model.levels[depth - 1], np.zeros(len(nodes), np.int64)
    for k, at in _each(_range_of(level.first, nodes)):
        out[at] = (EliasFano.read(load(level.files[k]), "keys").get(nodes[at] - level.first[k]) % np.uint64(model.words)).astype(np.int64)
    return out


def _suffix(model: Model, depth: int, nodes: np.ndarray) -> np.ndarray:
    """The node, one level up, of each node's words but the first."""
    if depth == 1:
        return np.zeros(len(nodes), np.int64)
    words, at = [], nodes
    for d in range(depth, 1, -1):
        words.append(_last_words(model, d, at))
        level = model.levels[d - 1]
        parent = np.zeros(len(at), np.int64)
        for k, part in _each(_range_of(level.first, at)):
            parent[part] = (EliasFano.read(load(level.files[k]), "keys").get(at[part] - level.first[k]) // np.uint64(model.words)).astype(np.int64) + int(level.edges[k])
        at = parent
    node = words.pop()
    for d in range(2, depth):
        node = children(model, d, node, words.pop())[0]
    return node


def _base(model: Model, counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + 1) / (model.total + model.words + 1))


def _texts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first and last, their tokens with ends, and the token's row."""
    for lo, hi in chunks(at, CHUNK_BYTES):
        words, ends = tokens(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        n = np.diff(ends)
        out = np.full(len(words) + hi - lo, END)
        row = np.repeat(np.arange(hi - lo), n + 1)
        out[np.arange(len(words)) + np.repeat(np.arange(hi - lo), n)] = words
        yield lo, hi, out, row


def _contexts(ids: np.ndarray, row: np.ndarray, end: int) -> np.ndarray:
    """The number before each token; an end before the first of a row."""
    before = np.empty_like(ids)
    before[0], before[1:] = end, ids[:-1]
    before[np.flatnonzero(np.diff(row)) + 1] = end
    return before


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.concatenate(counts)[order].astype(np.int64)
    del order
    heads = np.flatnonzero(np.diff(key, prepend=key[:1] - np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: what is alike lies together and packs well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(data: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).reshape(-1)


_PACKED = "part int, shard int, keys binary, counts binary"


def _packed(groups: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of part, shard, rising keys as differences, and counts."""
    part, shard, keys, counts = zip(*groups, strict=True) if groups else ([], [], [], [])
    keys = [_planes(np.diff(k, prepend=np.uint64(0))) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(shard, pa.int32()), pa.array(keys, pa.binary()), pa.array([_planes(c.astype(np.int64)) for c in counts], pa.binary())], names=["part", "shard", "keys", "counts"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    (keys, at), (counts, ends) = raw(batch.column(2)), raw(batch.column(3))
    for i, (part, shard) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield part, shard, np.cumsum(_values(keys[at[i] : at[i + 1]], np.uint64)), _values(counts[ends[i] : ends[i + 1]], np.int64)


def _counted(docs: DataFrame, text: str, keys: Callable, shard: Callable, parts: np.ndarray) -> DataFrame:
    """The distinct n-grams of texts with their counts, packed by shard; parts: how many parts each shard has."""
    at, first = column(docs, text), np.concatenate(([0], np.cumsum(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def sent() -> Iterator[pa.RecordBatch]:
            key, count = _summed(*held)
            own = shard(key)
            part = first[own] + (mix(key.copy()) % parts[own].astype(np.uint64)).astype(np.int64)
            yield _packed([(k, int(own[p[0]]), key[p], count[p]) for k, p in _each(part)])

        for batch in steps(batches):
            for _, _, words, row in _texts(*raw(batch.column(at))):
                key, count = np.unique(keys(words, row), return_counts=True)
                held[0].append(key)
                held[1].append(count.astype(np.int64))
                if sum(map(len, held[0])) > 2 * HELD:
                    key, count = _summed(*held)
                    held = [[key], [count]]
                    if len(key) > HELD:
                        yield from sent()
                        held = [[], []]
        if held[0]:
            yield from sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for _, own, key, count in _unpacked(batch):
                keys, counts = held.setdefault(own, ([], []))
                keys.append(key)
                counts.append(count)
        for own in list(held):
            key, count = _summed(*held.pop(own))
            for lo in range(0, len(key), HELD):
                yield _packed([(0, own, key[lo : lo + HELD], count[lo : lo + HELD])])

    made = docs.mapInArrow(run, _PACKED)
    if parts.max() > 1:
        made = made.repartitionById(int(first[-1]), F.col("part")).mapInArrow(merged, _PACKED)
    return made.repartitionById(len(parts), F.col("shard")).sortWithinPartitions("shard")


def _built(grams: DataFrame, name: str, build: Callable, weight: int) -> list:
    """shard, file, size, total and cuts of each shard: what build(shard, keys, counts) makes of its n-grams. cuts: the places of
    n-grams at which their counts pass a multiple of weight, and the sums of counts up to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [])

        def closed() -> pa.RecordBatch:
            keys, counts = _summed(*held)
            held[0].clear()
            held[1].clear()
            sums = np.cumsum(counts)
            at = np.concatenate(([0], np.flatnonzero(np.diff(sums // weight)) + 1))
            cuts = np.stack((at, np.diff(np.append(np.where(at > 0, sums[at - 1], 0), sums[-1])))).astype(np.int64)
            file, size, total = build(current, keys, counts)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([file]), pa.array([size], pa.int64()), pa.array([total], pa.int64()), pa.array([cuts.tobytes()], pa.binary())], names=["shard", "file", "size", "total", "cuts"])

        for batch in batches:
            for _, shard, keys, counts in _unpacked(batch):
                if shard != current:
                    if current is not None:
                        yield closed()
                    current = shard
                held[0].append(keys)
                held[1].append(counts)
        if current is not None:
            yield closed()

    made = written(grams.mapInArrow(run, "shard int, file string, size long, total long, cuts binary"), name)
    return sorted(made.collect(), key=lambda r: r["shard"])


def _cuts(made: list, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nodes of the shards of the next level, and the weight of each; first: that of each shard of this one."""
    each = [np.frombuffer(r["cuts"], np.int64).reshape(2, -1) for r in made]
    nodes = [x[0] + k for x, k in zip(each, first, strict=True)]
    return np.append(np.concatenate(nodes), first[-1] + made[-1]["size"]).astype(np.uint64), np.concatenate([x[1] for x in each])


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """The model of all rows of docs."""
    spark, docs = docs.sparkSession, docs.select(text)
    bounded(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // SHARD_BYTES) or 1
    folder = fresh_path(spark, "trie")
    cut = np.array([(k << 64) // n for k in range(n)] + [(1 << 64) - 1], np.uint64)

    def vocabulary(shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple[str, int, int]:
        width = int(cut[shard + 1]) - int(cut[shard])
        arrays = EliasFano.of(keys - cut[shard], width).arrays("keys") | {"counts": counts}
        return save(folder, arrays), len(keys), int(counts.sum())

    grams = _counted(docs, text, lambda words, row: words, lambda keys: _range_of(cut, keys), np.ones(n, np.int64))
    weight = max(1, size // n // TOKEN_BYTES)
    made = _built(grams, "words", vocabulary, weight)
    if not made:
        empty = save(folder, EliasFano.of(np.zeros(0, np.uint64), 1).arrays("keys") | {"counts": np.zeros(0, np.int64)})
        return Model(1, 0, [Level([empty], np.array([0, 0]), np.array([0, (1 << 64) - 1], np.uint64))])
    edges = np.array([*[int(cut[r["shard"]]) for r in made], (1 << 64) - 1], np.uint64)
    edges[0] = cut[made[0]["shard"]]
    model = Model(1, sum(r["total"] for r in made), [Level([r["file"] for r in made], np.concatenate(([0], np.cumsum([r["size"] for r in made]))), edges)])
    for depth in range(2, order + 1):
        made = _grow(docs, text, model, depth, *_cuts(made, model.levels[-1].first[[r["shard"] if depth > 2 else k for k, r in enumerate(made)]]), weight, folder)
    return model


def _ends(model: Model, most: int) -> list[int]:
    """The nodes of one end, two ends and so on."""
    end = numbers(model, np.array([END]))[0]
    nodes = [end]
    for depth in range(2, most + 1):
        nodes.append(children(model, depth, nodes[-1], end)[0])
    return [int(x[0]) for x in nodes]


def _grow(docs: DataFrame, text: str, model: Model, depth: int, cut: np.ndarray, weights: np.ndarray, weight: int, folder: str) -> list:
    """Give model the level `depth`, in shards of the nodes from each of cut to the next; what _built() returns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    words = np.uint64(model.words)

    def keys(tokens_: np.ndarray, row: np.ndarray) -> np.ndarray:
        known = shared.value
        ids, _ = numbers(known, tokens_)
        ends, node = _ends(known, depth - 1), ids
        for d in range(2, depth):
            node = children(known, d, _contexts(node, row, ends[d - 2]), ids)[0]
        node = _contexts(node, row, ends[-1])
        return (node[node >= 0].astype(np.uint64) * words + ids[node >= 0].astype(np.uint64))

    def level(shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple[str, int, int]:
        known = shared.value
        low, high = int(cut[shard]), int(cut[shard + 1])
        node, word = (keys // words).astype(np.int64), (keys % words).astype(np.int64)
        pointers = np.searchsorted(node, np.arange(low, high + 1))
        kinds = np.diff(pointers)
        sums = np.concatenate(([0], np.cumsum(counts)))
        total = sums[pointers[1:]] - sums[pointers[:-1]]
        lower = 10 ** _lower(known, depth, node, word)
        at = node - low
        logs = np.log10((counts + kinds[at] * lower) / (total[at] + kinds[at]))
        # The least code of a node with children is 1, as 0 tells of none.
        back = np.where(kinds > 0, np.maximum(_code(np.log10(np.maximum(kinds, 1) / np.maximum(total + kinds, 1))), 1), 0).astype(np.uint8)
        arrays = EliasFano.of(at.astype(np.uint64) * words + word.astype(np.uint64), (high - low) * int(words)).arrays("keys")
        arrays |= EliasFano.of(pointers.astype(np.uint64), len(keys) + 1).arrays("pointers") | {"logs": _code(logs), "back": back}
        return save(folder, arrays), len(keys), int(counts.sum())

    parts = -(-weights // weight)
    made = _built(_counted(docs, text, keys, lambda k: _range_of(cut, k // words), parts), f"grams-{depth}", level, weight)
    by_shard = {r["shard"]: r for r in made}
    files, sizes = [], []
    for k in range(len(cut) - 1):
        if k in by_shard:
            files.append(by_shard[k]["file"])
            sizes.append(by_shard[k]["size"])
        else:
            none = np.zeros(0, np.uint64)
            files.append(save(folder, EliasFano.of(none, 1).arrays("keys") | EliasFano.of(none, 1).arrays("pointers") | {"logs": none.astype(np.uint8), "back": np.zeros(int(cut[k + 1] - cut[k]), np.uint8)}))
            sizes.append(0)
    model.levels.append(Level(files, np.concatenate(([0], np.cumsum(sizes))), cut))
    model.order = depth
    return made


def _lower(model: Model, depth: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 p(word | words of the node but the first), for nodes of level depth - 1 whose children the words are."""
    if depth == 2:
        return _base(model, counts_of(model, word))
    heads = np.flatnonzero(np.diff(node, prepend=-1))
    return children(model, depth - 1, np.repeat(_suffix(model, depth - 1, node[heads]), np.diff(np.append(heads, len(node)))), word)[1]


def log_probabilities(model: Model, ids: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each token, given those before it in its row."""
    out = _base(model, counts)
    if model.order < 2:
        return out
    # What a token ends at one level is what the token after it has for a context at the next.
    nodes = ids
    for depth, end in enumerate(_ends(model, model.order - 1), 2):
        nodes, logs, back = children(model, depth, _contexts(nodes, row, end), ids)
        out = np.where(nodes >= 0, logs, back + out)
    return out


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score in place of the text; columns that have these names already are replaced."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), column(docs, text)

    def compute(batch: pa.RecordBatch) -> list:
        known, out = shared.value, []
        for lo, hi, words, row in _texts(*raw(batch.column(at))):
            ids, counts = numbers(known, words)
            logs = log_probabilities(known, ids, counts, row)
            sums = [np.bincount(row, x, hi - lo) for x in (np.ones(len(row)), ids >= 0, _base(known, counts), logs)]
            out.append(np.stack(sums))
        n, seen, base, total = np.concatenate(out, axis=1) if out else np.zeros((4, 0))
        return [pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.full(len(n), known.total, np.int64)), pa.array(base), pa.array(total)]

    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return with_arrays(docs, compute, [T.StructField(*x) for x in kinds], (text,))


def learned(docs: DataFrame, where: Column, text: str = "text") -> DataFrame:
    """The rows to learn from; a null in the condition counts as no."""
    return docs.filter(F.coalesce(where, F.lit(False)))
