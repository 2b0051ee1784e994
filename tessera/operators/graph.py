"""Operators over an edge table (source_id, target_id, type, ...) and a node table (id, type, name, file_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cycles import strong_components

# Prefixes of ids that stand for nothing in the tree.
OUTSIDE = ["external:", "unresolved:"]
#: Distinct importers from which a target is a hotspot of a graph.
HOTSPOT = 20


def is_outside(node: Column) -> Column:
    """Whether an id is that of an external package or of a failed resolution."""
    return node.startswith(OUTSIDE[0]) | node.startswith(OUTSIDE[1])


def incident(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """JOI-01: edges out of, into or at the ids (a column id); a self-loop appears twice in both."""
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def missing(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """JOI-02, JOI-03: edges whose end (source_id or target_id) is no node and isn't outside."""
    known = nodes.select(F.col("id").alias(end)).distinct()
    return edges.filter(~is_outside(F.col(end))).join(known, end, "left_anti")


def hotspots(edges: DataFrame, least: int = HOTSPOT) -> DataFrame:
    """AGG-04: targets with at least `least` distinct sources."""
    return edges.groupBy("target_id").agg(F.countDistinct("source_id").alias("n_sources")).filter(F.col("n_sources") >= least)


def duplicates(edges: DataFrame) -> DataFrame:
    """AGG-06: how many more times than once an edge occurs."""
    return edges.groupBy("source_id", "target_id", "type").agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def fan(edges: DataFrame) -> DataFrame:
    """AGG-07: id, fan_out and fan_in: how many different nodes each reaches and is reached from."""
    ends = edges.select("source_id", "target_id").distinct()
    out = ends.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    into = ends.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "id", "full_outer").select("id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def core(edges: DataFrame, k: int = 5) -> DataFrame:
    """AGG-08: the k targets with the most edges, by id on a tie."""
    return edges.groupBy("target_id").agg(F.count("*").alias("n_edges")).orderBy(F.desc("n_edges"), "target_id").limit(k)


def risk(total: Column, models: Column, apis: Column) -> Column:
    """GRA-04: R3 for a model among more than two, R2 for an API among more than one or for more than three, R1 for any."""
    return F.when((models > 0) & (total > 2), "R3").when((apis > 0) & (total > 1), "R2").when(total > 3, "R2").when(total > 0, "R1").otherwise("R0")


def impact(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """GRA-02, JOI-04: for each target id how many dependents it has, of which kinds, and the risk of a change."""
    dependents = edges.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("target_id", F.col("source_id").alias("id")).distinct()
    known = dependents.join(nodes.select("id", "type"), "id", "left")
    counts = known.groupBy("target_id").agg(F.count("*").alias("total"), F.count_if(F.col("type") == "model").alias("models"), F.count_if(F.col("type") == "api").alias("apis"))
    return targets.select(F.col("id").alias("target_id")).join(counts, "target_id", "left").select(
        "target_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "models", "apis")]
    ).withColumn("risk", risk(F.col("total"), F.col("models"), F.col("apis")))


def health(edges: DataFrame, nodes: DataFrame, least: int = HOTSPOT) -> DataFrame:
    """GRA-06: rule, severity and subject of the errors and warnings of a graph."""
    lost = lambda end, rule, severity: missing(edges, nodes, end).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(end).alias("subject")).distinct()
    twice = duplicates(edges).select(F.lit("duplicate_edge"), F.lit("warning"), F.concat_ws("->", "source_id", "target_id"))
    hot = hotspots(edges, least).select(F.lit("hotspot"), F.lit("warning"), "target_id")
    return lost("source_id", "missing_source", "error").union(lost("target_id", "missing_target", "warning")).union(twice).union(hot)


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """GRA-09, an extension: id and the least number of steps, up to depth, from the starts."""
    ends = edges.select("source_id", "target_id").distinct()
    found = front = starts.select("id").distinct().withColumn("steps", F.lit(0))
    for step in range(1, depth + 1):
        front = front.join(ends, front["id"] == ends["source_id"]).select(F.col("target_id").alias("id")).distinct().withColumn("steps", F.lit(step))
        found = found.unionByName(front)
    return found.groupBy("id").agg(F.min("steps").alias("steps"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """GRA-01: the nodes that lie on a cycle, self-loops counted; edges with a null end are on none."""
    return strong_components(edges).select("id")
