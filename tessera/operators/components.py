"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", merge: bool = False) -> DataFrame:
    """node and root (the least node of its component) for the nodes of edges, self-loops left out.

    A large star links the larger neighbours of a node to the least of its neighbourhood, a small star the smaller ones;
    repeated until nothing changes (about the square of the log of the longest path), every node hangs on the least of its component. Each step is a join of edges with a
    row for each node, written to the shared folder, so that adaptive execution splits nodes of many edges. With merge no table is
    sent through the driver to be joined, even if its file is small.
    """
    kept = lambda df, name: written(df, name).hint("merge") if merge else written(df, name)
    now = kept(edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).filter("a > b").distinct().select("a", "b"), "edges")
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = kept(now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a")
        after = kept(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "edges")
        for table in (now, least, large, low):
            discard(table)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
