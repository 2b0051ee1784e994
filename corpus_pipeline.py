"""Corpus cleaning from documents to token ids.

Each stage reads what the one before it wrote: low quality goes, then toxic documents, then all but one of each class of
near copies, then documents that hold a benchmark item; the rest are encoded and decoded again. All stages but the last return the columns
of documents. Models are fitted on the labelled rows among the documents that a stage gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.pipeline import civil, distinct, encoded, good, unseen
from tessera.llm.store import written

STAGES = [("quality", good), ("toxicity", civil), ("near copies", distinct), ("decontamination", unseen), ("encoding", encoded)]
#: A trained model and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
