from __future__ import annotations

import random

import pytest

from tessera.operators import cycles
from tessera.operators import graph as G
from tessera.operators import snapshot as S
from tessera.operators.cycles import strong_components
from tessera.sources.store import written


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "imports") for a, b in pairs], "source_id string, target_id string, type string")


def test_cycles(spark):
    ids = lambda *pairs: {r.id for r in G.cycle_nodes(edges(spark, *pairs)).collect()}
    assert ids(("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")) == {"a", "b", "c", "d", "e"}
    assert ids(("a", "a"), ("a", "b")) == {"a"}
    assert ids(("a", "b"), ("b", "c")) == set()
    # A path between two cycles is on none.
    assert ids(("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "x")) == {"a", "b", "x", "y"}


def test_cycles_of_many_components_equal_reachability(spark):
    rng = random.Random(5)
    for n, m in ((12, 16), (60, 75)):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("n1", None), (None, "n1"), (None, None)]
        after = {f"n{i}": {b for a, b in pairs if a == f"n{i}" and b} for i in range(n)}
        wanted = set()
        for start in after:
            seen, front = set(), after[start]
            while front:
                seen |= front
                front = set().union(*(after[x] for x in front)) - seen
            wanted |= {start} & seen
        assert {r.id for r in G.cycle_nodes(edges(spark, *pairs)).collect()} == wanted and wanted


def components_of(pairs):
    """The sets of nodes that reach each other, by search from each."""
    after, nodes = {}, {x for p in pairs for x in p}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    reach = {}
    for start in nodes:
        seen, front = set(), [start]
        while front:
            for x in after.get(front.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    front.append(x)
        reach[start] = seen
    return {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("local", [0, 10, 50_000])
def test_strong_components_equal_reachability(spark, local):
    """In rounds to the end, in rounds until little is left, and in one task."""
    rng = random.Random(7)
    pairs = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("r2", "t0"), ("t0", "t1"), ("t1", "t2")]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("p30", "p5"), ("p33", "p33"), ("p5", "q"), ("q", "p6")]
    pairs += [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(16)] + [("t2", "p0"), ("p40", "n0")]
    by = {}
    for r in strong_components(edges(spark, *pairs, ("p1", None)), local=local).collect():
        by.setdefault(r.root, []).append(r.id)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, components_of(pairs)))


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(cycles, "written", lambda df, name: made.append(name) or written(df, name))
    pairs = [(f"p{i:04}", f"p{i + 1:04}") for i in range(300)] + [("p0250", "p0100")]
    assert {r.id for r in strong_components(edges(spark, *pairs), local=0).collect()} == {f"p{i:04}" for i in range(100, 251)}
    assert len(made) < 80


def test_impact_and_health(spark):
    nodes = spark.createDataFrame([("a", "model"), ("b", "api"), ("c", "x")], "id string, type string")
    e = edges(spark, ("a", "t"), ("b", "t"), ("c", "t"), ("b", "u"), ("zz", "u"), ("b", "external:js:react"), ("b", "u"))
    found = {r.target_id: r.risk for r in G.impact(e, nodes, spark.createDataFrame([("t",), ("u",), ("none",)], "id string")).collect()}
    assert found == {"t": "R3", "u": "R2", "none": "R0"}
    health = {(r.rule, r.subject) for r in G.health(e, nodes, 3).collect()}
    assert health == {("missing_source", "zz"), ("missing_target", "t"), ("missing_target", "u"), ("duplicate_edge", "b->u"), ("hotspot", "t")}
    loop = edges(spark, ("a", "a"))
    assert G.incident(loop, spark.createDataFrame([("a",)], "id string")).count() == 2


def test_queries_of_nothing(spark):
    none = edges(spark, ("a", "b")).limit(0)
    assert G.cycle_nodes(none).count() == G.fan(none).count() == G.core(none).count() == 0


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "k string, h string")
    act = lambda x, y: {r.k: r.action for r in S.upsert(x, y, ["k"], ["h"]).collect()}
    assert act(old, new) == {"a": "skipped", "b": "updated", "c": "skipped", "d": "inserted"}
    assert set(act(new, new).values()) == {"skipped"}
    assert act(new, old)["d"] == "removed"
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx")], "id int, before string, after string")
    assert {(r.line, r.action, r.content) for r in S.line_diff(pairs, "id", "before", "after").collect()} == {(2, "remove", "b"), (2, "add", "x"), (3, "remove", "c")}
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, n int, v string")
    assert {(r.k, r.v) for r in S.latest(rows, ["k"], ["n"]).collect()} == {(1, "y"), (2, "z")}
    assert [r.v for r in S.repeats(rows, ["k"], "n").collect()] == ["y"]
