"""Benchmark decontamination: size-partitioned MinHash containment search of short items inside long documents.

Items and documents are sets of five-word shingles; an item of one to four words is one shingle of that many words, and
one without words is in no document. A document holds an item if it has at least the share `least` of its shingles.

Items are partitioned by size, by powers of two. From the upper bound u of its partition follows how many MinHash
values an item's sketch has: the floor((1 - least) u) + 1 smallest hashes. A document that has `least` of an item's
shingles lacks too few of them to miss all of its sketch, so that the search loses nothing. A document's shingles are
tested against the sketches of all items at once, through a bit table; each item met is then verified by exact
containment. Documents are read where they are: nothing of them is shuffled, and copies need no care.

Sketches are sent to all executors in blocks of BLOCK_BYTES of items' texts; more items mean more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.frames import bounded, column, steps, unused, with_arrays
from tessera.llm.text import SHINGLE, chunks, mix, raw, shingles, tokens

LEAST = 0.8
BLOCK_BYTES = 16 << 20
_TABLE = 1 << 20


class Items:
    """The shingles and sketches of a block of items."""

    def __init__(self, keys: list, texts: list[str | None], least: float = LEAST) -> None:
        self.least = least
        self.keys, self.sets, self.sizes = [], [], []
        sketch: dict[int, list[tuple[np.ndarray, int]]] = {}
        data, at = raw(pa.array(texts, pa.string()))
        words, ends = tokens(data, at)
        for i, key in enumerate(keys):
            own = words[ends[i] : ends[i + 1]]
            if not len(own):
                continue
            size = min(len(own), SHINGLE)
            found = np.unique(shingles(own, np.array([0, len(own)]), size)[0])
            bound = 1 << (len(found) - 1).bit_length()
            smallest = found[np.argsort(mix(found))][: int((1 - least) * bound + 1e-9) + 1]
            sketch.setdefault(size, []).append((smallest, len(self.sets)))
            self.keys.append(key)
            self.sets.append(found)
            self.sizes.append(size)
        self.sketches = {}
        for size, parts in sketch.items():
            hashes = np.concatenate([s for s, _ in parts])
            owner = np.concatenate([np.full(len(s), i) for s, i in parts])
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(_TABLE, dtype=bool)
            table[hashes % np.uint64(_TABLE)] = True
            self.sketches[size] = hashes[order], owner[order], table

    def search(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the items that rows of texts hold."""
        out = []
        words, ends = tokens(data, at)
        for size, (hashes, owner, table) in self.sketches.items():
            found, row = shingles(words, ends, size, short=False)
            maybe = np.flatnonzero(table[found % np.uint64(_TABLE)])
            lo, hi = np.searchsorted(hashes, found[maybe], "left"), np.searchsorted(hashes, found[maybe], "right")
            n = hi - lo
            places = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            met = np.unique(np.repeat(row[maybe], n) * len(self.sets) + owner[places])
            last, own = -1, found[:0]
            for r, i in zip((met // len(self.sets)).tolist(), (met % len(self.sets)).tolist(), strict=True):
                if r != last:
                    last, own = r, np.unique(found[np.searchsorted(row, r) : np.searchsorted(row, r, "right")])
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if shared >= self.least * len(self.sets[i]) - 1e-9:
                    out.append((r, i, shared))
        return sorted(out)

    def search_column(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        data, at = raw(texts)
        return [(lo + r, i, shared) for lo, hi in chunks(at) for r, i, shared in self.search(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])]


def blocks(items: DataFrame, key: str, text: str, least: float = LEAST) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text, of which the driver holds one at a time."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n))
    for k in range(n):
        rows = sorted(((r[0], r[1]) for r in items.filter(block == k).select(key, text).collect()), key=lambda r: (str(r[0]), r[1] or ""))
        yield Items([r[0] for r in rows], [r[1] for r in rows], least)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each document and item that it holds: their keys, shared and n_shingles of the item, containment.

    Rows that repeat a key are documents or items of their own. Null texts hold nothing and are in nothing. Other
    columns of docs and items have no part in the result.
    """
    bounded(spark := docs.sparkSession)
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], items.schema[item_key], *[T.StructField(n, T.LongType()) for n in ("shared", "n_shingles")], T.StructField("containment", T.DoubleType())])
    kind = to_arrow_type(items.schema[item_key].dataType)

    def searcher(shared):
        def run(batches):
            for batch in steps(batches):
                held, found = shared.value, shared.value.search_column(batch.column(1))
                rows, each, counts = ([x[k] for x in found] for k in range(3))
                sizes = [len(held.sets[i]) for i in each]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([held.keys[i] for i in each], kind), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([c / s for c, s in zip(counts, sizes, strict=True)], pa.float64())],
                    names=schema.names,
                )

        return run

    return reduce(DataFrame.unionAll, [docs.mapInArrow(searcher(spark.sparkContext.broadcast(block)), schema) for block in blocks(items, item_key, item_text, least)])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are, whatever they are called."""
    out, names, flag = docs, docs.columns, unused(docs, "holds_item")
    for block in blocks(items, item_key, item_text, least):
        shared, at = docs.sparkSession.sparkContext.broadcast(block), column(docs, text)

        def held(batch: pa.RecordBatch, shared=shared, at=at) -> list:
            flags = np.zeros(batch.num_rows, dtype=bool)
            flags[[r for r, _, _ in shared.value.search_column(batch.column(at))]] = True
            return [pa.array(flags)]

        out = with_arrays(out, held, [T.StructField(flag, T.BooleanType())]).filter(~F.col(flag)).select(*names)
    return out
