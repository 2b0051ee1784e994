from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.supervised import BUCKETS, SAMPLE, Sample, distinct, fold, sample
from tessera.llm.text import raw


def sampled(texts, labels, features):
    row, bucket = distinct(*features(*raw(pa.array(texts))))
    return Sample(bucket.astype(np.int32), np.searchsorted(row, np.arange(len(texts) + 1)), np.array(labels, np.int32), sum(labels) / len(labels))


def scores(model, texts, features):
    return model.scores(*distinct(*features(*raw(pa.array(texts)))), len(texts))


def either(n, others, vocabulary):
    """Texts and labels that no additive model can tell: one of two words but not both, which is a matter of the pair."""
    rng, texts, labels = random.Random(0), [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["insult"] * a + ["group"] * b + [f"w{rng.randrange(vocabulary)}" for _ in range(others)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a != b))
    return texts, np.array(labels)


@pytest.mark.parametrize("n,others,vocabulary", [(1200, 3, 40), (2 * SAMPLE - 500, 3, 40), (3000, 30, 200), (3000, 100, 400)])
def test_the_machine_learns_pairs(n, others, vocabulary):
    """On rows that it wasn't fitted on; without its vectors the same machine fails."""
    texts, labels = either(n + 500, others, vocabulary)
    machine = toxicity.fit(sampled(texts[:-500], labels[:-500].tolist(), toxicity.features))
    right = (scores(machine, texts[-500:], toxicity.features) > 0.5) == labels[-500:]
    machine.vectors = np.zeros_like(machine.vectors)
    additive = (scores(machine, texts[-500:], toxicity.features) > 0.5) == labels[-500:]
    assert right.mean() > 0.98 and additive.mean() < 0.8


def test_margins_are_the_sums_of_the_definition():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(0.5, rng.normal(size=BUCKETS), rng.normal(size=(BUCKETS, 3)))
    row, bucket = np.array([0, 0, 0, 2]), np.array([3, 9, 27, 9])
    pairs = sum(machine.vectors[i] @ machine.vectors[j] for i, j in ((3, 9), (3, 27), (9, 27)))
    want = [0.5 + machine.weights[[3, 9, 27]].sum() + pairs / 3**0.5, 0.5, 0.5 + machine.weights[9]]
    assert np.allclose(machine.margins(row, bucket, 3), want)


def test_descent_reaches_the_optimum():
    """Small changes of the weights don't lower the objective."""
    rng = np.random.default_rng(2)
    n, m = 60, 8
    x, y = rng.normal(size=(n, m)), np.where(rng.random(n) < 0.5, -1.0, 1.0)
    w, b = quality.descend(x.reshape(-1), np.tile(np.arange(m), n), np.arange(0, n * m + 1, m), y, np.full(n, 0.3), epochs=2000)
    value = lambda v: 0.5 * v @ v + 0.3 * np.maximum(0, 1 - y * (x @ v[:m] + v[m])).sum()
    best = np.append(w[:m], b)
    assert all(value(best) <= value(best + d) + 1e-6 for d in rng.normal(scale=0.01, size=(300, m + 1)))


def test_quality_tells_shapes():
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of and in to a land river".split()) + rng.choice(["", "", ","]) for _ in range(40)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "x|y", "###"]) for _ in range(40)) for _ in range(75)] + [(rng.choice(["spam ", "heat "])) * 40 for _ in range(75)]
    model = quality.fit(sampled(good + bad, [1] * 150 + [0] * 150, quality.features))
    got = scores(model, [good[3] + " more words", "WIN!! WIN!! NOW!!", "loop " * 50, ""], quality.features)
    assert got[0] > 0.5 > got[1] and got[2] < 0.5 and 0 <= got[3] <= 1


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.1), (3, "", 0.1), (1, "a b c", 0.5), (None, "x", 0.0), (4, "long " * 100_000, 0.2)], "doc_id long, text string, Score double")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.train(docs, none, F.lit(True))
    out = module.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == 6
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0), (4, 0)], f"doc_id long, {label} int")
    model = module.train(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert module.score(docs.limit(0), model).count() == 0
    assert module.fit(Sample(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), 0.5)) is not None


def test_the_sample_is_bounded_and_outside_the_fold(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = sample(docs, labels, "doc_id", "text", "quality", fold("doc_id", 3) != 1, quality.features, limit=30)
    assert len(got.labels) == 60 and got.labels.sum() == 30
    want = {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert abs(got.prior - sum(i % 2 for i in want) / len(want)) < 1e-12


def test_the_sample_is_bounded_by_bytes(spark):
    """Rows in the order of their keys' hashes, one of each class in turn, until the bytes are full."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    whole = sample(docs, labels, "doc_id", "text", "quality", F.lit(True), toxicity.features)
    some = sample(docs, labels, "doc_id", "text", "quality", F.lit(True), toxicity.features, most=4 * int(whole.at[-1]) // 3)
    assert len(whole.labels) == 40 and 10 <= len(some.labels) <= 14 and abs(2 * int(some.labels.sum()) - len(some.labels)) <= 1
    assert some.buckets.nbytes <= 4 * int(whole.at[-1]) // 3 and some.prior == whole.prior
    place = {i: h for i, h in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    chosen = {i for y in (0, 1) for i in sorted((k for k in place if k % 2 == y), key=place.get)[: int((some.labels == y).sum())]}
    own = sample(docs.filter(F.col("doc_id").isin(sorted(chosen))), labels, "doc_id", "text", "quality", F.lit(True), toxicity.features)
    assert (own.buckets == some.buckets).all() and (own.labels == some.labels).all()


def test_held_out_accuracy(spark, sf_dir):
    from tessera.llm.queries import op3_toxicity, op10_quality

    big = sf_dir.replace("0.001", "0.1")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for query, n, rest, label, least in ((op10_quality, 3, 1, "quality", 0.97), (op3_toxicity, 4, 2, "toxic", 0.95)):
        rows = query(spark, big).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
        held = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
        assert sum(a == b for a, b in held) / len(held) > least
        if label == "toxic":
            toxic, clean = [a for a, b in held if b], [a for a, b in held if not b]
            assert sum(toxic) > 0.55 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_toxicity_query_is_the_sum_over_all_pairs(spark, sf_dir):
    from tessera.llm.queries import op3_toxicity

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels, fold("doc_id", 4) != 2)
    got = {r.doc_id: (r.score, r.predicted) for r in op3_toxicity(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        hashes, _ = toxicity.features(*raw(pa.array([text])))
        terms = sorted(b for b in {int(h) % BUCKETS for h in hashes} if machine.weights[b] != 0)
        v = machine.vectors[terms].astype(float)
        gram = v @ v.T
        margin = machine.bias + machine.weights[terms].astype(float).sum() + sum(gram[i, i + 1 :].sum() for i in range(len(terms))) / max(len(terms), 1) ** 0.5
        want = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        assert abs(got[key][0] - want) < 1e-4 and got[key][1] == (got[key][0] >= 0.3)


def test_quality_query_is_the_plain_sum(spark, sf_dir):
    from tessera.llm.queries import op10_quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, fold("doc_id", 3) != 1)
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], [scores(model, [r.text], quality.features)[0] for r in rows], strict=True))
    got = {r.doc_id: (r.score, r.predicted) for r in op10_quality(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-9 and got[k][1] == (got[k][0] >= 0.5) for k in want)
