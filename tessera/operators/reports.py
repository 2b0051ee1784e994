"""Reports over an edge table: sections of a project's map, and the health of its graph, with totals by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import HOTSPOT, is_outside
from tessera.sources.store import written

MODULE = "code:module:"
# Keys that the metadata of an import has.
IMPORT_KEYS = ["module", "import_kind", "confidence"]


def _named(edges: DataFrame) -> DataFrame:
    """class, source and target of edges: files by path, packages from outside by name."""
    target = F.col("target_id")
    group = F.when(target.startswith("external:"), "external").when(target.startswith("unresolved:"), "unresolved").otherwise("internal")
    name = F.when(target.startswith(MODULE), F.expr("substring(target_id, 13)")).when(target.startswith("external:"), F.regexp_extract("target_id", "^external:[^:]*:(.*)$", 1)).otherwise(target)
    source = F.when(F.col("source_id").startswith(MODULE), F.expr("substring(source_id, 13)"))
    return edges.select(group.alias("class"), source.alias("source"), name.alias("target"))


def sections(edges: DataFrame, least: int = 2, high: int = 5) -> DataFrame:
    """GRA-07, AGG-03, AGG-05, AGG-07, AGG-25 over source_id and target_id: section, subject, n_edges, n_files and risk, from one pass.

    Sections: module (the imports of a file), internal, external and unresolved (the targets of each kind), kind (all edges of a kind) and
    total. n_files counts the different files that import. A target inside with `least` of them or more is a hotspot, R1, or
    R2 from `high` on. Sources that are no files count as edges alone.
    """
    spark = edges.sparkSession
    rows = spark.sql(
        """SELECT class, source, target, grouping_id(class, source, target) AS level, count(*) AS n_edges, count(DISTINCT source) AS n_files
           FROM {rows} GROUP BY class, source, target GROUPING SETS ((source), (class, target), (class), ())""",
        rows=_named(edges),
    )
    section = F.when(F.col("level") == 5, "module").when(F.col("level") == 2, F.col("class")).when(F.col("level") == 3, "kind").otherwise("total")
    subject = F.when(F.col("level") == 5, F.col("source")).when(F.col("level") == 2, F.col("target")).when(F.col("level") == 3, F.col("class")).otherwise("all")
    risk = F.when((section == "internal") & (F.col("n_files") >= high), "R2").when((section == "internal") & (F.col("n_files") >= least), "R1")
    return rows.select(section.alias("section"), subject.alias("subject"), "n_edges", "n_files", risk.alias("risk")).filter("section <> 'module' OR subject IS NOT NULL")


def members(edges: DataFrame) -> DataFrame:
    """AGG-03, AGG-05, AGG-07: section, subject and member, a row for each: what a file imports and by what a target is imported, with
    repeats, and the different importers of each target. Lists are rows, as a target may have more importers than a row can hold."""
    rows = written(_named(edges), "named")
    imports = rows.filter("source IS NOT NULL").select(F.lit("imports").alias("section"), F.col("source").alias("subject"), F.col("target").alias("member"))
    imported = rows.filter("class = 'internal' AND source IS NOT NULL").select(F.lit("imported_by"), "target", "source")
    importers = rows.filter("source IS NOT NULL AND class <> 'unresolved'").select(F.concat("class", F.lit("_importers")), "target", "source").distinct()
    return imports.unionAll(imported).unionAll(importers)


def health_counts(edges: DataFrame, nodes: DataFrame, least: int = HOTSPOT) -> DataFrame:
    """GRA-06, AGG-25, AGG-27 over source_id, target_id, type and metadata_json: rule, severity and n, with totals for each severity
    and for all, where rule, or both, are all.

    Edges are looked at in one pass: ends that are no node and aren't outside, imports whose metadata lack a key, and how many edges
    lead outside or to nothing. Repeats of an edge and targets of many files are aggregates of their own.
    """
    known = nodes.select("id").distinct().withColumn("known", F.lit(True))
    rows = edges
    for end in ("source_id", "target_id"):
        rows = rows.join(known.select(F.col("id").alias(end), F.col("known").alias(f"known_{end}")).hint("merge"), end, "left")
    keys = F.coalesce(F.json_object_keys("metadata_json"), F.array().cast("array<string>"))
    lacks = (F.col("type") == "imports") & (F.size(F.array_except(F.array(*map(F.lit, IMPORT_KEYS)), keys)) > 0)
    lost = lambda end: F.col(f"known_{end}").isNull() & ~is_outside(F.col(end))
    rules = [
        ("orphan_source", "error", lost("source_id")), ("orphan_target", "warning", lost("target_id")), ("missing_metadata", "warning", lacks),
        ("external", "info", F.col("target_id").startswith("external:")), ("unresolved", "info", F.col("target_id").startswith("unresolved:")),
    ]
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), on.alias("on")) for rule, severity, on in rules])
    counts = rows.select(F.inline(F.filter(each, lambda x: x["on"]))).groupBy("rule", "severity").agg(F.count("*").alias("n"))
    twice = edges.groupBy("source_id", "target_id", "type").agg((F.count("*") - 1).alias("extra")).filter("extra > 0").agg(F.sum("extra").alias("n")).filter("n > 0")
    hot = edges.filter("type = 'imports'").groupBy("target_id").agg(F.countDistinct(F.when(F.col("source_id").startswith(MODULE), F.col("source_id"))).alias("m")).filter(F.col("m") >= least).agg(F.count("*").alias("n")).filter("n > 0")
    for rule, part in (("duplicate", twice), ("hotspot", hot)):
        counts = counts.unionByName(part.select(F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), "n"))
    return edges.sparkSession.sql("SELECT coalesce(rule, 'all') AS rule, coalesce(severity, 'all') AS severity, sum(n) AS n FROM {counts} GROUP BY rule, severity GROUPING SETS ((rule, severity), (severity), ())", counts=counts)
