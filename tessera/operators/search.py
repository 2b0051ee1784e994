"""Full-text search: BM25 over an inverted index in the shared folder, and substring search where that has no answer.

An index has postings in folders by a checksum of the term, the number of rows that hold each term, and one row of statistics.
A search reads the folders of its own terms alone, so several searches share one index. Without one, `bm25` scans the rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import fresh_path

K1, B = 1.2, 0.75
SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"
#: Folders that postings are dealt to.
FOLDERS = 64


def plain(text: str) -> str:
    """A text without marks on its letters, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def terms(text: Column) -> Column:
    """The words of a text in lower case; marks on Latin letters go."""
    marked, bare = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.filter(F.split(F.translate(F.lower(text), marked, bare), SEPARATOR), lambda w: w != "")


def _count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def bm25(rows: DataFrame, key: str, text: str, query: str, k: int = 20) -> DataFrame:
    """SEA-01, TOP-01: key and score of the k rows that have all words of the query, by score, then key.

    Counts of the words asked for are taken from each row where it is read; only rows that hold one of them go on.
    """
    asked = [w for w in re.split(r"[^\w]+|_", plain(query)) if w]
    if not asked:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    words = terms(F.col(text))
    counted = rows.select(key, F.size(words).alias("length"), F.array(*[_count(words, x) for x in asked]).alias("tf"))
    held = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(asked))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *held)
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.get("tf", F.lit(i))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return counted.filter(F.forall("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats)).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def asked_words(query: str) -> Counter:
    """The words of a query and how often it has each."""
    return Counter(w for w in re.split(r"[^\w]+|_", plain(query)) if w)


def index(rows: DataFrame, key: str, columns: list[str], path: str | None = None) -> str:
    """SEA-01: write an index of the words of the columns, which count as one text, and return its path.

    A row's words are sorted and their runs counted where it is read. Postings are dealt by folder; adaptive execution splits a
    folder that a frequent word makes large. Rows that repeat a key are rows of their own; a row of nulls has no words.
    """
    path = path or fresh_path(rows.sparkSession, "index")
    words = F.sort_array(terms(F.concat_ws(" ", *columns)))
    each = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    each = each.select("row", "key", "words", F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))
    run = lambda at, k: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - at).alias("tf"))
    runs = each.select("row", "key", F.size("words").alias("length"), F.inline(F.transform("starts", run)))
    folder = (F.crc32(F.col("term").cast("binary")) % FOLDERS).cast("int").alias("folder")
    runs.select(folder, "term", "row", "key", "length", "tf").hint("rebalance", "folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/postings")
    kind = rows.schema[key].dataType.simpleString()
    stored = rows.sparkSession.read.schema(_postings(kind)).parquet(f"{path}/postings")
    stored.groupBy("folder", "term").agg(F.count("*").alias("df")).hint("rebalance", "folder").write.partitionBy("folder").parquet(f"{path}/terms")
    each.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.lit(kind).alias("kind")).write.parquet(f"{path}/stats")
    return path


def _postings(kind: str) -> str:
    return f"folder int, term string, row long, key {kind}, length int, tf int"


def lookup(spark: SparkSession, path: str, query: str, k: int = 20, digits: int | None = None) -> DataFrame:
    """SEA-01, TOP-01 by an index: key and score of the k rows that have all words of the query, by score, then key.

    A row's parts are added in the order of the query's words, so that rows with the same counts have the same score to the last bit.
    With digits the score is rounded before rows are put in order.
    """
    asked = asked_words(query)
    folders = sorted({zlib.crc32(w.encode()) % FOLDERS for w in asked})
    here = F.col("folder").isin(folders) & F.col("term").isin(list(asked))
    stats = spark.read.parquet(f"{path}/stats")
    postings = spark.read.schema(_postings(stats.first()["kind"])).parquet(f"{path}/postings").filter(here)
    if not asked:
        return postings.select("key", F.lit(0.0).alias("score")).limit(0)
    held = spark.read.schema("folder int, term string, df long").parquet(f"{path}/terms").filter(here).select("folder", "term", "df")
    times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = times[F.col("term")] * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = postings.join(F.broadcast(held), ["folder", "term"]).crossJoin(F.broadcast(stats))  # a row for each asked word, and one row
    parts = [F.max(F.when(F.col("term") == w, part)).alias(f"p{i}") for i, w in enumerate(asked)]
    score = reduce(Column.__add__, [F.col(f"p{i}") for i in range(len(asked))])  # null where a word is lacking
    found = weighed.groupBy("row", "key").agg(*parts).select("key", (score if digits is None else F.round(score, digits)).alias("score"))
    return found.filter("score IS NOT NULL").orderBy(F.desc("score"), "key").limit(k)


def like(rows: DataFrame, key: str, columns: list[str], query: str, k: int = 20) -> DataFrame:
    """SEA-02, TOP-02: the k rows with the query in one of the columns, in any case of ASCII letters, by key; % and _ are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    form = F.lit("%" + query.translate(str.maketrans(upper, lower)) + "%")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.like(F.translate(F.col(c), upper, lower), form), F.lit(False))
    return rows.filter(hit).orderBy(key).limit(k)


def search(rows: DataFrame, key: str, path: str, columns: list[str], query: str, k: int = 20) -> DataFrame:
    """SEA-01 by the index at path, with SEA-02 where the query isn't words or no row has them: the keys found."""
    if not re.search(r"[^\w\s]", query) and (best := lookup(rows.sparkSession, path, query, k).collect()):
        return rows.sparkSession.createDataFrame([(r["key"],) for r in best], rows.select(key).schema)
    return like(rows, key, columns, query, k).select(key)
