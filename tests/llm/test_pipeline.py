from __future__ import annotations

import hashlib

import corpus_pipeline as C
import public_tokenizers as P
from tessera.llm import bpe
from tessera.llm.queries import BPE_RANKS
from tests.llm import brute


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    sizes = [kept.count()]
    for name, stage in C.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == columns
        assert kept.join(before, columns, "left_anti").count() == 0
        rows = [(r.doc_id, r.text) for r in before.collect()]
        ids = {r.doc_id for r in kept.collect()}
        if name == "near copies":
            assert ids == {c for c, _ in brute.near_classes(rows).values()}
        if name == "decontamination":
            assert ids == {k for k, _ in rows} - {d for d, *_ in brute.leaks(rows, items)}
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    coder = bpe.Bpe(bpe.read_ranks(BPE_RANKS), P.PATTERN)
    texts = {r.doc_id: r.text for r in kept.collect()}
    last = C.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id: bytes(r.ids) for r in last} == dict(zip(texts, coder.encode(list(texts.values())), strict=True))
    assert {r.doc_id for r in C.run(spark, sf_dir).collect()} == set(texts)


def test_no_documents(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_the_last_stage_decodes(spark, sf_dir):
    texts = [(1, "de", "web", "Grüße, Welt\n\n 12"), (2, "en", "web", ""), (3, "en", "web", None)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r.decoded_sha256 for r in C.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, _, _, t in texts}


def test_extra_columns_keep_their_values(spark, sf_dir):
    rows = [(1, "en", "web", "plain words of a text", 5, "t"), (2, "en", "web", "other words " * 100_000, 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, score_of_text int, holds_item string")
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= set(rows)
