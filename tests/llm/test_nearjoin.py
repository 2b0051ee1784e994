from __future__ import annotations

import random

import pytest

from tessera.llm import nearjoin as N
from tessera.llm.components import components
from tests.llm import brute


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    """Copies, chains, near copies on both sides of the threshold and a passage that many texts share."""
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for _ in range(25):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        rows += [" ".join(base)] * rng.randint(1, 3)
        rows += [edited(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
    near = [f"n{i}" for i in range(150)]
    rows += [edited(rng, near, rng.randint(1, 4)) for _ in range(70)]
    rows += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30]))) for _ in range(80)]
    rows += ["", None, "  \n", "a", "A", "a b", "one two three four", "One  two\nthree four", "word " * 30_000]
    return list(enumerate(rows))


def joined(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("limits", [(48, 512), (4, 8)])
def test_equals_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(N, "SMALL", limits[0])
    monkeypatch.setattr(N, "BLOCK", limits[1])
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(N.join(docs)) == brute.near_classes(rows)


def test_texts_are_joined_by_key_when_many(spark, monkeypatch):
    monkeypatch.setattr(N, "SENT_KEYS", 0)
    rows = [(i, " ".join(f"w{j}" for j in range(50)) + f" end{i}") for i in range(6)]
    assert joined(N.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_classes(rows)


def test_one_of_each_and_odd_rows(spark):
    text = " ".join(f"w{j}" for j in range(60))
    rows = [(5, text, "x"), (2, text + " more", "y"), (9, "other", "z"), (None, text, "n"), (7, text, "x"), (2, text + " more", "y"), (4, None, "e"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = N.one_of_each(docs)
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted([r.doc_id for r in out.collect()], key=str) == sorted([2, 9, None, 3], key=str)
    assert N.join(docs).filter("doc_id = 2").count() == 2
    assert N.join(docs.limit(0)).count() == N.one_of_each(docs.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert N.runs_for(0.9, 0.8) < N.runs_for(0.9999, 0.8) <= N.runs_for(0.9999, 0.5)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_query(spark, sf_dir):
    from tessera.llm.queries import op4_nearjoin

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert joined(op4_nearjoin(spark, sf_dir)) == brute.near_classes(rows)
