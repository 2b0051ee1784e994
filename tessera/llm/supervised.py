"""What the two text classifiers share: a bounded labelled sample, packed features and prior correction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import column, with_arrays
from tessera.llm.store import written
from tessera.llm.text import chunks, raw

#: Buckets that terms are hashed to.
BUCKETS = 1 << 18
#: Most labelled rows of each class that a model is fitted on, and most bytes of their packed features, which the driver gets.
SAMPLE, SAMPLE_BYTES = 2500, 64 << 20


def fold(key: str, n: int) -> Column:
    """crc32 of a column's text modulo n; null for a null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


@dataclass
class Sample:
    """Sorted buckets of each row, end to end; where rows start; labels; the share of label 1 among all rows learned from."""

    buckets: np.ndarray
    at: np.ndarray
    labels: np.ndarray
    prior: float

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.labels)), np.diff(self.at))


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, bucket) of hashed terms, sorted."""
    pairs = np.unique(row.astype(np.int64) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learned: Column, features: Callable, limit: int = SAMPLE, most: int = SAMPLE_BYTES) -> Sample:
    """Features of at most `limit` labelled rows of each class, those with the least hashes of their keys, and of as many of these, class by
    class in turn, as have `most` bytes of features together.

    Null keys and labels aren't learned from; of several labels of a key the largest counts, of several texts the one
    whose features sort first.
    """
    spark = docs.sparkSession
    known = labels.filter(learned & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = []
    for y in (0, 1):
        chosen += [(r[0], y) for r in known.filter(F.col("label") == y).orderBy(F.xxhash64(key), key).select(key).limit(limit).collect()]
    picked = spark.createDataFrame(chosen, T.StructType([labels.schema[key], T.StructField("label", T.IntegerType())]))
    rows = docs.select(key, text).join(F.broadcast(picked), key)
    at = column(rows, text)

    def packed(batch: pa.RecordBatch) -> list:
        data, offsets = raw(batch.column(at))
        out = []
        for lo, hi in chunks(offsets):
            row, bucket = distinct(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            bucket = bucket.astype(np.int32)
            out += [bucket[ends[i] : ends[i + 1]].tobytes() for i in range(hi - lo)]
        return [pa.array(out, pa.binary())]

    made = with_arrays(rows, packed, [T.StructField("packed", T.BinaryType())], (text,))
    table = written(made.groupBy(key, "label").agg(F.min("packed").alias("packed")), "sample")
    sizes, took, total = table.select(F.col(key).alias("key"), "label", F.octet_length("packed").alias("size"), F.xxhash64(key).alias("place")).collect(), [], 0
    turns = [[r for r in sorted(sizes, key=lambda r: (r["place"], str(r["key"]))) if r["label"] == y] for y in (0, 1)]
    for r in (r for pair in zip_longest(*turns) for r in pair if r is not None):
        total += r["size"]
        if total > most:
            break
        took.append((r["key"], r["label"]))
    if len(took) < len(sizes):
        table = table.join(F.broadcast(spark.createDataFrame(took, picked.schema)), [key, "label"])
    found = sorted(table.collect(), key=lambda r: (str(r[0]), r["label"]))
    parts = [np.frombuffer(r["packed"], np.int32) for r in found]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    total = sum(counts.values())
    return Sample(np.concatenate(parts) if parts else np.zeros(0, np.int32), at, np.array([r["label"] for r in found], np.int32), counts.get(1, 0) / total if total else 0.5)


def log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(docs: DataFrame, text: str, features: Callable, model: Callable, name: str = "score") -> DataFrame:
    """docs with what the model makes of each text's features, in place of the text.

    model(row, bucket, n): scores of n rows from their sorted distinct (row, bucket).
    """
    at = column(docs, text)

    def compute(batch: pa.RecordBatch) -> list:
        data, offsets = raw(batch.column(at))
        out = [np.zeros(0)]
        for lo, hi in chunks(offsets):
            row, bucket = distinct(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            out.append(model(row, bucket, hi - lo))
        return [pa.array(np.concatenate(out), pa.float64())]

    return with_arrays(docs, compute, [T.StructField(name, T.DoubleType())])
