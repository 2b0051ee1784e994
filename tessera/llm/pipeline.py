"""The stages of the corpus pipeline.

Each takes the documents that the one before it kept and returns, but for the last, the same columns of those that it
keeps, whatever other columns they have and whatever these are called. Models are fitted on the labelled rows among the
documents that a stage gets. Null and empty texts are scored like any other, are copies of each other, hold no benchmark
item and have no ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, nearjoin, quality, toxicity
from tessera.llm.frames import unused
from tessera.llm.queries import BPE_RANKS, GOOD_FROM, TOXIC_FROM
from tessera.llm.store import written


def _scored(docs: DataFrame, scorer, model, keep) -> DataFrame:
    """The rows of docs for whose score `keep` holds; the scorer gets a copy of the text, in columns that docs doesn't have."""
    text, score = unused(docs, "scored_text"), unused(docs, "score_of_text")
    return scorer(docs.withColumn(text, F.col("text")), model, text, score).filter(keep(F.col(score))).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score below GOOD_FROM go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return _scored(docs, quality.score, model, lambda score: score >= GOOD_FROM)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a score of at least TOXIC_FROM go."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return _scored(docs, toxicity.score, machine, lambda score: score < TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies the document with the least id stays."""
    return nearjoin.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, lang and source with the packed ids of the text, their number and a digest of the decoded bytes."""
    # Ids are written before they are decoded, so that no executor has workers for both at once.
    ids = written(bpe.encode(docs.select("doc_id", "lang", "source", "text"), BPE_RANKS, public_tokenizers.PATTERN).drop("text"), "ids")
    return bpe.decode(ids, BPE_RANKS, public_tokenizers.PATTERN).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
