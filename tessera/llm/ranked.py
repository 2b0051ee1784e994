"""Ranked lexical search: postings by term, joined with the terms of items.

A term is a maximal run of ASCII letters and digits and characters beyond ASCII, with A-Z lower-cased. A document's
postings are made where its text is read, by counting its terms in Arrow batches, so nothing is shuffled. Each part
of the postings is sorted by bucket and term, so that a reader that asks for few buckets skips the rest of a file.

Scores are integers. A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))) for N documents with terms, of which df
hold it. A document with n terms has m = 10 + 90 n N div L, where L counts the terms of all. It scores the sum over the
item's different terms of w (10^9 tf div (1000 tf + 8 m)). A document without terms, empty or null, has no postings but
for its own row, and an item without terms finds nothing. Rows of documents with one key are ranked apart, in the order
they are read in; items of one key, null keys among them, are one item with the terms of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import bounded, steps
from tessera.llm.store import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1024
#: The bucket of the rows that stand for documents.
DOCUMENT = -1
#: Bytes of items' terms up to which they are sent to every executor.
SENT_BYTES = 32 << 20
BATCH_BYTES, PIECE = 2 << 20, 1 << 20
#: Each byte in a term, lower-cased; a space for those between terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Parts that a term's postings are cut into where items' terms aren't sent.
SALTS = 32


def terms(text: Column) -> Column:
    """The terms of a text in order; of a null none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def counts(text: bytes) -> Counter:
    """How often a text's bytes in UTF-8 have each term, PIECE bytes at a time."""
    text, found, lo = text.translate(_TERM_BYTES), Counter(), 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE) if len(text) - lo > PIECE else -1
        hi = len(text) if hi < 0 else hi
        found.update(text[lo:hi].split())
        lo = hi
    return found


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, term, row, key, n (terms of the document) and tf, in the shared folder, for each document and different term of it,
    and for each document a row of the bucket DOCUMENT without a term. Other columns of docs are left out."""
    bounded(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, BATCH_BYTES):
            found = [counts(x or b"") for x in batch.column(2).to_pylist()]
            sizes = np.array([len(c) + 1 for c in found], np.int64)
            of = pa.array(np.repeat(np.arange(len(found)), sizes))
            words = pa.array([w for c in found for w in (None, *c)], pa.binary()).view(pa.string())
            tf = np.array([k for c in found for k in (0, *c.values())], np.int64)
            n = np.repeat(np.array([c.total() for c in found], np.int64), sizes)
            yield pa.RecordBatch.from_arrays([words, batch.column(0).take(of), batch.column(1).take(of), pa.array(n), pa.array(tf)], names=schema.names)

    bucket = F.when(F.col("term").isNull(), DOCUMENT).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    found = rows.mapInArrow(run, schema).select(bucket.alias("bucket"), *schema.names)
    return written(found.sortWithinPartitions("bucket", "term"), "postings")


def weight(df: Column, n: int) -> Column:
    return F.floor(1000 * F.log((2 * n + 2) / (2 * df + 1))).cast("long")


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, sent: int = SENT_BYTES) -> DataFrame:
    """item, rank, doc (the key), score of the k documents with the best scores above 0 for each item; ties go by key, nulls first, then row.

    Items whose terms take no more than `sent` bytes go to every executor: postings of their terms are scored, dealt by
    document, and each part sums and ranks its own documents, of which k for each item go on. More terms are joined with
    the postings by term and salt.
    """
    pairs = written(items.select(F.col(item).alias("item"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).distinct(), "pairs")
    asked = pairs.select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    small = (pairs.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0) <= sent
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
    stats = index.filter(F.col("bucket") == DOCUMENT).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n, total = stats[0], max(stats[1] or 0, 1)
    held = index.filter(F.col("bucket").isin(wanted))
    hint = F.broadcast if small else lambda x: x
    known = held.select("bucket", "term").join(hint(asked), ["bucket", "term"]).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    known = written(known.select(F.monotonically_increasing_id().alias("number"), "bucket", "term", weight(F.col("df"), n).alias("w")), "terms")
    m = 10 + F.expr(f"(90 * n * {n}L) div {total}L")
    match = lambda rows: rows.withColumn("m", m).withColumn("score", F.col("w") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)"))
    if small:
        scored = match(held.join(F.broadcast(known), ["bucket", "term"])).select("row", "key", "number", "score")
        of = known.join(F.broadcast(pairs), "term").select("number", "item")
        rows = scored.repartition("row").join(F.broadcast(of), "number")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        of = known.join(pairs, "term").select("bucket", "term", "w", "item", salt)
        rows = match(held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(of, ["bucket", "term", "salt"]))
    summed = rows.groupBy("item", "row", "key").agg(F.sum("score").alias("score")).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key", "row"))
    best = summed.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("item", "rank", F.col("key").alias("doc"), "score")


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The k best documents of each item by new postings of docs; columns are named as the two keys, rank and score."""
    out = search(postings(docs, key, text), items, item, text, k)
    return out.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
