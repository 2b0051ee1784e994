from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lm
from tessera.llm.eliasfano import EliasFano, load, save
from tests.llm import brute


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=30))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.uint64)
    e = EliasFano.of(v, 2**40)
    assert (e.get(np.arange(len(v))) == v).all()
    assert (e.find(v) == np.arange(len(v))).all()
    place = {x: i for i, x in enumerate(sorted(values))}
    assert e.find(np.array(others, np.uint64)).tolist() == [place.get(x, -1) for x in others]


def test_pointers_repeat_and_files_are_mapped(tmp_path):
    v = np.array([0, 0, 0, 3, 3, 9, 9, 9], np.uint64)
    file = save(f"file://{tmp_path}", EliasFano.of(v, 10).arrays("p") | {"x": np.arange(5)})
    arrays = load(file)
    assert (EliasFano.read(arrays, "p").get(np.arange(8)) == v).all() and arrays["x"].tolist() == list(range(5))
    assert not arrays["x"].flags.writeable


class Plain:
    """Witten-Bell by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, Counter()
        # A gram counts if what comes before its last word does; two ends before a text do if some text is empty.
        for k in range(order):
            for t in texts:
                w = ["</>"] * (order - 1) + brute.words(t) + ["</>"]
                grams = [tuple(w[j - k : j + 1]) for j in range(order - 1, len(w))]
                self.counts.update([g for g in grams if k == 0 or g[:-1] in known])
            known = set(self.counts)
        self.one = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.total, self.kinds = Counter(), Counter()
        for g, c in self.counts.items():
            self.total[g[:-1]] += c
            self.kinds[g[:-1]] += 1

    def p(self, gram):
        if len(gram) == 1:
            return (self.counts[gram] + 1) / (self.n + self.v + 1)
        c = gram[:-1]
        if not self.total[c]:
            return self.p(gram[1:])
        return (self.counts[gram] + self.kinds[c] * self.p(gram[1:])) / (self.total[c] + self.kinds[c])

    def scores(self, text):
        w = ["</>"] * (self.order - 1) + brute.words(text) + ["</>"]
        grams = [tuple(w[j - self.order + 1 : j + 1]) for j in range(self.order - 1, len(w))]
        return len(grams), sum(g[-1:] in self.one for g in grams), sum(math.log10(self.p(g[-1:])) for g in grams), sum(math.log10(self.p(g)) for g in grams)


TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a cat", "", None, "the the the the", "a\tdog\nran", "x " * 5000]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("shard", [30, 1 << 25])
def test_equals_dictionaries(spark, monkeypatch, order, shard):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + ["unknown words on the mat", "cat"])], "doc_id int, text string, score int")
    learned = lm.learned(docs, docs["doc_id"] < len(TEXTS))
    out = lm.score(docs, lm.train(learned, order=order))
    plain = Plain(TEXTS, order)
    texts = {i: t for i, t in enumerate(TEXTS + ["unknown words on the mat", "cat"])}
    for r in out.collect():
        n, known, base, score = plain.scores(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, plain.n)
        assert abs(r.base_score - base) < 1e-9 * n and abs(r.score - score) < 0.03 * n


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    out = {r.doc_id: r for r in lm.score(docs, lm.train(docs.limit(0))).collect()}
    assert out[1].n_tokens == 3 and out[1].n_known == 0 and out[2].n_tokens == 1 and out[1].base_score == out[1].score == 0.0
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def test_query(spark, sf_dir):
    from tessera.llm.queries import op9_lm

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    plain = Plain([t for i, t in texts.items() if not held[i]], 2)
    rows = op9_lm(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base, score = plain.scores(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, plain.n)
        assert abs(r.base_score - base) < 1e-8 * n and abs(r.score - score) < 0.03 * n
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
