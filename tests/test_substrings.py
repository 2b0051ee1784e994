from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import substrings
from tessera.operators.rules import companions
from tessera.operators.substrings import contained
from tessera.sources.store import written


def test_equals_a_search_for_each(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcé/.") for _ in range(rng.randrange(60)))) for i in range(120)] + [(200, None), (201, ""), (202, "ab" * 3_000 + "needle"), (0, "abc")]
    whole = "".join(t or "" for _, t in texts[:100])
    patterns = sorted({whole[(k := rng.randrange(len(whole))) : k + rng.choice([1, 2, 5, 6, 7, 12, 30])] for _ in range(60)} | {"needle", "no such", "zzzzzzzzz", ""})
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {(r.id, r.pattern) for r in contained(rows, "id", "text", spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string")).collect()}
    assert got == {(i, p) for i, t in texts for p in patterns if p and t and p in t}
    assert contained(rows, "id", "text", spark.createDataFrame([], "pattern string")).count() == 0


def test_words_equal_a_search_for_each(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["a", "b", "é", "𝄞", "\n", " ", " "]) for _ in range(rng.randrange(80)))) for i in range(150)]
    texts += [(150, None), (151, "a " + "b" * 50_000 + " c d"), (152, "aa bb cc"), (None, "aa bb cc")]
    whole = " ".join(t or "" for _, t in texts[:100])
    patterns = sorted({whole[(k := rng.randrange(len(whole))) : k + rng.choice([3, 5, 7, 9, 14])] for _ in range(80)} | {"a bb c", "a  b", " a b ", "b c d", "aa  bb", "  ", "a b c d e f"})
    rows, asked = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    true = {(i, p) for i, t in texts for p in patterns if p and t and i is not None and p in t}
    for most in (substrings.FEW, 10):  # sent to the texts, and merged
        monkeypatch.setattr(substrings, "FEW", most)
        got = [(r.id, r.pattern) for r in contained(rows, "id", "text", asked).collect()]
        assert set(got) == true and len(got) == len(true)


def test_texts_are_cut_to_words_once(spark):
    """A text of words gives a gram for each of them, not for each character, in one pass that does not move the texts."""
    rows = spark.createDataFrame([(i, " ".join(f"somewhat{i}{k}long" for k in range(100))) for i in range(20)], "id int, text string")
    found = contained(rows, "id", "text", spark.createDataFrame([("somewhat38long somewhat39long somewhat",)], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "SortMergeJoin" not in plan
    assert [r.id for r in found.collect()] == [3]
    assert rows.select(F.explode(substrings._grams(F.col("text"), 0))).count() == 20 * 98


def test_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "abc")], "id int, text string")
    plan = contained(rows, "id", "text", spark.createDataFrame([("b",)], "pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_patterns_are_not_sent_to_the_driver(spark, monkeypatch):
    """The files of these tables are small enough for a broadcast, their rows needn't be."""
    monkeypatch.setattr(substrings, "FEW", 10)
    rows = written(spark.range(500).selectExpr("id", "concat('tests/test_', id, '.py') AS text"), "texts")
    patterns = written(spark.range(0, 900, 3).selectExpr("concat('test_', id, '.py') AS pattern"), "patterns")
    found = contained(rows, "id", "text", patterns)
    assert {(r.id, r.pattern) for r in found.collect()} == {(i, f"test_{i}.py") for i in range(0, 500, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    changes = spark.range(100).selectExpr("concat('src/a', id, '.py') AS path")
    plan = companions(changes.unionAll(rows.select("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
