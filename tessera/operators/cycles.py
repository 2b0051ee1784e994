"""Strong components of an edge table, in rounds that follow the logarithm of the length of its paths where it is thin.

Nodes that lead to each other directly become one, by connected components. Then nodes with one way in hang on the node
before it, and these pointers are doubled: after as many rounds as the logarithm of the longest chain each knows the node that
its chain starts from, or its chain runs round a cycle. Chains, and whole trees, thus become their start, and the same is done
for nodes with one way out. What is left is thick, and colours find its cycles: a node's colour is the greatest id that a path
leads from to it, and nodes of a colour from which a path inside the colour leads back are one component. Many
colours, each a pivot of its own, are looked at in one round. What has no more than LOCAL_EDGES edges, from the start or when the rest has
become so small, is finished in one task. Every table is at most as long as the edges and is written to the
shared folder, so each step starts from files. Layers of a thick graph without cycles are peeled one a round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.sources import store
from tessera.sources.store import discard

#: Edges up to which one task finds components.
LOCAL_EDGES = 50_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and read again, to be merged where it is joined: rounds are many, and with each a small file of many rows would go
    through the driver."""
    return store.written(df, name).hint("merge")


def strong_components(edges: DataFrame, source: str = "source_id", target: str = "target_id", local: int = LOCAL_EDGES) -> DataFrame:
    """id and root for each node that lies on a cycle: nodes of one component have one root. A node whose only cycle is an edge to
    itself is its own; edges with a null end are on no cycle."""
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    return _strong(written(ends, "edges"), local)


def _in_one_task(bucket: pa.Table) -> pa.Table:
    """id and root of the nodes on cycles of the edges a to b: components in the order in which depth-first search leaves them."""
    after: dict = {}
    for a, b in zip(bucket.column("a").to_pylist(), bucket.column("b").to_pylist(), strict=True):
        after.setdefault(a, []).append(b)
    seen, low, open_, ids, roots = {}, {}, {}, [], []
    for start in after:
        path = [] if start in seen else [(start, iter(after[start]))]
        while path:
            node, rest = path[-1]
            if node not in seen:
                seen[node] = low[node] = len(seen)
                open_[node] = None
            for other in rest:
                if other not in seen:
                    path.append((other, iter(after.get(other, ()))))
                    break
                if other in open_:
                    low[node] = min(low[node], seen[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == seen[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_.popitem()[0])
                    if len(own) > 1:
                        ids += own
                        roots += [node] * len(own)
    kind = bucket.schema.field("a").type
    return pa.table({"id": pa.array(ids, kind), "root": pa.array(roots, kind)})


def _strong(edges: DataFrame, local: int) -> DataFrame:
    """The components of distinct edges a to b; their table is deleted."""
    loops = edges.filter("a = b").select(F.col("a").alias("id"))
    rest = edges.filter("a <> b")
    entered, left = rest.select(F.col("b").alias("a")).distinct(), rest.select(F.col("a").alias("b")).distinct()
    now = written(rest.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b"), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    if now.count() <= local:
        found = written(now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_in_one_task, f"id {kind}, root {kind}"), "components")
    else:
        found = _inner(now, local)
    out = written(found.unionByName(loops.join(found, "id", "left_anti").withColumn("root", F.col("id"))), "components")
    for table in (now, edges, found):
        discard(table)
    return out


def _inner(edges: DataFrame, local: int) -> DataFrame:
    """The components of edges without self-loops, by the first way that applies."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = written(edges.join(back, ["a", "b"], "left_semi").filter("a < b"), "pairs")
    if not pairs.isEmpty():
        return _merged(edges, pairs, local)
    discard(pairs)
    for turned in (edges, back):  # components stay the same where all edges are turned round
        single = written(turned.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("to")).filter("n = 1").select(F.col("b").alias("id"), "to"), "single")
        if not single.isEmpty():
            return _contracted(turned.select("a", "b"), single, local)
        discard(single)
    return _coloured(edges, local)


def _doubled(single: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Pointers (id, to, least) after 0, 1, 2 ... doublings, those of nodes whose chains end, and those of the others."""
    ids = single.select("id")
    steps = [written(single.select("id", "to", F.least("id", "to").alias("least")), "pointers")]
    endless = lambda now: now.join(ids.withColumnRenamed("id", "to"), "to", "left_semi").select("id", "to", "least")
    n, reach = endless(steps[0]).count(), 1
    while n:
        now = steps[-1]
        then = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"))
        steps.append(written(now.join(then, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.least("least", "low").alias("least")), "pointers"))
        reach, before, n = 2 * reach, n, endless(steps[-1]).count()
        if n == before and reach >= n:  # each chain that ends has nodes of every distance, so some would have got to its start
            break
    around = written(endless(steps[-1]), "around")
    return steps, steps[-1].join(around, "id", "left_anti"), around


def _contracted(edges: DataFrame, single: DataFrame, local: int) -> DataFrame:
    """The components where the nodes of single (id, to: its one way in) become the start of their chains.

    A chain that runs round is a component, which nothing enters; nodes that hang on it are on no cycle. Another node of a chain is
    on a cycle if a node after it, or itself, has an edge whose ends are of one component when chains are their starts: that
    component's nodes all reach it through the start.
    """
    steps, starts, around = _doubled(single)
    starts = written(starts.select("id", F.col("to").alias("start")), "starts")
    rounds = around.select(F.col("to").alias("id")).distinct().join(around.select("id", F.col("least").alias("root")), "id")
    outer = edges.join(single.select(F.col("id").alias("b")), "b", "left_anti").join(around.select(F.col("id").alias("a")), "a", "left_anti")
    outer = outer.join(starts.select(F.col("id").alias("a"), "start"), "a", "left")
    outer = written(outer.select(F.col("a").alias("origin"), F.coalesce("start", "a").alias("a"), "b"), "outer")
    inner = _strong(written(outer.select("a", "b").distinct(), "edges"), local)
    of = lambda end: inner.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    good = outer.join(of("a"), "a").join(of("b"), "b").filter("root_a = root_b").select(F.col("origin").alias("id"), F.col("root_a").alias("root"))
    marked = written(good.join(single.select("id"), "id", "left_semi").distinct(), "marked")
    used = [*steps, single, starts, around, outer]
    if not marked.isEmpty():
        for step in steps:  # ancestors at every distance are sums of powers of two
            more = marked.join(step.select("id", "to"), "id").select(F.col("to").alias("id"), "root").join(single.select("id"), "id", "left_semi")
            used.append(marked)
            marked = written(marked.unionByName(more).distinct(), "marked")
    used.append(marked)
    out = written(inner.unionByName(marked).unionByName(rounds.select("id", "root")), "components")
    for table in [*used, inner]:
        discard(table)
    return out


def _merged(edges: DataFrame, pairs: DataFrame, local: int) -> DataFrame:
    """The components where nodes that lead to each other directly are one."""
    one = written(components(pairs, "a", "b", merge=True).select(F.col("node").alias("id"), F.col("root").alias("own")), "merged")
    both = edges
    for end in ("a", "b"):
        both = both.join(one.select(F.col("id").alias(end), F.col("own").alias(f"own_{end}")), end, "left")
    both = both.select(F.coalesce("own_a", "a").alias("a"), F.coalesce("own_b", "b").alias("b")).filter("a <> b").distinct()
    inner = _strong(written(both, "edges"), local)
    larger = inner.select(F.col("id").alias("own"), "root")
    out = one.join(larger, "own", "left").select("id", F.coalesce("root", "own").alias("root"))
    out = written(out.unionByName(inner.join(one.select("id"), "id", "left_anti")), "components")
    for table in (one, inner, pairs):
        discard(table)
    return out


def spread(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """nodes (id, the label, moved and others) after each node has the greatest label among its own and those of the nodes
    from which a path of edges leads to it. Only labels of nodes that `moved` are sent on. Each round is written to the
    shared folder in place of the one before; there are as many as the longest of the shortest paths that labels take."""
    others = [c for c in nodes.columns if c not in (label, "moved")]
    now = written(nodes, "labels")
    while not (front := now.filter("moved")).isEmpty():
        best = front.join(edges, F.col("id") == F.col("a")).groupBy("b").agg(F.max(label).alias("best"))
        better = now.join(best.withColumnRenamed("b", "id"), "id", "left")
        after = written(better.select(*others, F.greatest(label, "best").alias(label), F.coalesce(F.col("best") > F.col(label), F.lit(False)).alias("moved")), "labels")
        discard(now)
        now = after
    return now


def _coloured(edges: DataFrame, local: int) -> DataFrame:
    """The component of the greatest id of each colour, and those of what is left inside colours."""
    nodes = edges.select(F.col("a").alias("id")).distinct()
    colours = spread(nodes.select("id", F.col("id").alias("colour"), F.lit(True).alias("moved")), edges, "colour")
    same = edges
    for end in ("a", "b"):
        same = same.join(colours.select(F.col("id").alias(end), F.col("colour").alias(f"of_{end}")), end)
    same = written(same.filter("of_a = of_b").select("a", "b"), "edges")
    head = F.col("id") == F.col("colour")
    back = spread(colours.select("id", "colour", head.alias("leads_back"), head.alias("moved")), same.select(F.col("b").alias("a"), F.col("a").alias("b")), "leads_back")
    found = written(back.filter("leads_back").select("id", F.col("colour").alias("root")), "components")
    left = same
    for end in ("a", "b"):
        left = left.join(found.select(F.col("id").alias(end)), end, "left_anti")
    rest = _strong(written(left.select("a", "b"), "edges"), local)
    lone = found.groupBy("root").agg(F.count("*").alias("n")).filter("n = 1").select("root")  # without a way back
    out = written(found.join(lone, "root", "left_anti").unionByName(rest), "components")
    for table in (colours, same, back, found, rest):
        discard(table)
    return out
