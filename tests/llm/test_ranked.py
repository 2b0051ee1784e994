from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import ranked
from tests.llm.brute import lower


def plain(docs, items, k=10):
    """item to its best (doc, score), by the definition; docs: (key, text) in order."""
    words = [(key, Counter(re.findall(ranked.TERM, lower(text)))) for key, text in docs]
    n, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df, asked, out = Counter(t for _, c in words for t in c), {}, {}
    for item, text in items:
        asked.setdefault(item, set()).update(re.findall(ranked.TERM, lower(text)))
    for item, terms in asked.items():
        found = []
        for row, (key, c) in enumerate(words):
            m = 10 + 90 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, key is not None, key or 0, row, key))
        out[item] = [(i + 1, x[4], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return {item: x for item, x in out.items() if x}


def got(out):
    rows = {}
    for r in sorted(out.collect(), key=lambda r: r.rank):
        rows.setdefault(r.item, []).append((r.rank, r.doc, r.score))
    return rows


@pytest.mark.parametrize("sent", [ranked.SENT_BYTES, 0])
def test_search_equals_the_definition(spark, sent):
    rng = random.Random(3)
    vocabulary = ["the"] * 20 + [f"w{i}" for i in range(60)] + ["Ünï", "x1", "10"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(7, "the w1 w1"), (7, "the w1 w1"), (None, "w2 W2 THE"), (201, None), (202, ""), (203, "?!"), (204, "the " * 50_000 + "w3")]
    items = [(1, "the W1, w2"), (2, "Ünï x1 x1 unknown"), (3, None), (4, ""), (5, "unknown"), (1, "w3"), (None, "w4 10")]
    index = ranked.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert got(ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), sent=sent)) == plain(docs, items)
    assert got(ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), k=3, sent=sent)) == plain(docs, items, 3)


def test_no_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", "y", 1)], "doc_id long, text string, tf int, Term string, item string, row int")
    items = spark.createDataFrame([(1, "a", 9)], "item_id long, text string, score int")
    out = ranked.rank(docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r)[:3] for r in out.collect()] == [(1, 1, 1)]
    assert ranked.rank(docs.limit(0), items).count() == 0 and ranked.rank(docs, items.limit(0)).count() == 0


def test_a_reader_asks_for_its_terms_buckets(spark):
    index = ranked.postings(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert sorted(r.bucket for r in index.collect())[0] == ranked.DOCUMENT and index.count() == 4
    plan = ranked.search(index, spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(bucket,", plan) or re.search(r"PushedFilters: \[[^\]]*In\(bucket", plan)
