"""Merkle manifests: a tree of digests over the rows of each group, a root over the groups, and a proof for each row.

H is the lower-case hex SHA-256 of its inputs end to end, digests as hex text. A leaf is H over the row's fields, each `-` if
null, else its UTF-8 bytes' number, a colon and itself. A group's leaves ascend by key, nulls first; two consecutive
nodes, the last of a level maybe alone, become their H until one is left, the group's subroot. Subroots, by group as
UTF-8 bytes, a null group first, likewise give the root.

Leaves are hashed where rows are read, so texts are never shuffled. Leaves get their places in the group; each aligned
block of 2^LEVELS is one Arrow bucket, whose levels DuckDB computes in a task. Blocks' roots are the nodes of the next turn,
so turns are the logarithm of rows to that base, and the proofs of blocks are joined to those of their rows.

Rows with equal keys keep the order they are read in, so repeated rows have proofs of their own. Empty and null texts
differ. No rows give no rows.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbering import numbered
from tessera.llm.store import written

#: Levels of a block.
LEVELS = 12
_engines: list = []


def encoded(field: Column) -> Column:
    said = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _engine():
    """This worker's DuckDB, in memory and of one thread."""
    if not _engines:
        _engines.append(duckdb.connect(config={"threads": "1", "memory_limit": "256MB", "temp_directory": ""}))
    return _engines[0]


def _levels(bucket: pa.Table) -> pa.Table:
    """A block's rows with `path`, a sibling for each level with its side before it or an empty text, and `top`, the block's root."""
    engine, height = _engine(), bucket.column("height")[0].as_py()
    engine.register("bucket", bucket.select(["inner_place", "digest"]))
    engine.execute(f"CREATE OR REPLACE TEMP TABLE node AS SELECT 0 AS level, inner_place AS place, digest FROM bucket")
    for k in range(height):
        engine.execute(f"INSERT INTO node SELECT {k + 1}, place // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM node WHERE level = {k} GROUP BY place // 2")
    found = engine.sql(f"""
        WITH own AS (SELECT place, k, (place >> k) % 2 AS side, xor(place >> k, 1) AS other FROM node, range({height}) r(k) WHERE level = 0)
        SELECT own.place, list(CASE WHEN digest IS NULL THEN '' WHEN side = 1 THEN 'L' || digest ELSE 'R' || digest END ORDER BY k) AS path
        FROM own LEFT JOIN node ON level = k AND node.place = other GROUP BY own.place ORDER BY own.place""").to_arrow_table()
    top = engine.execute(f"SELECT digest FROM node WHERE level = {height}").fetchall()[0][0]
    engine.unregister("bucket")
    bucket = bucket.sort_by("inner_place")
    path = found.column("path").cast(pa.list_(pa.string())) if height else pa.array([[]] * len(bucket), pa.list_(pa.string()))
    return bucket.append_column("path", path).append_column("top", pa.array([top] * len(bucket), pa.string()))


def rooted(nodes: DataFrame, tree: str, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, place, size of the tree, digest and others) with `path` up to the root of their tree, and `root`."""
    height = F.when(F.col("size") > 1, F.least(F.lit(levels), F.length(F.bin(F.col("size") - 1)))).otherwise(0)
    rows = nodes.withColumns({"block": F.shiftright("place", levels), "inner_place": F.col("place").bitwiseAND((1 << levels) - 1), "height": height})
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, path array<string>, top string"
    done = written(rows.groupBy(tree, "block").applyInArrow(_levels, schema), "levels")
    largest = done.agg(F.max("size")).first()[0]
    if (largest or 0) <= 1 << levels:
        return done.select(*nodes.columns, "path", F.col("top").alias("root"))
    tops = done.filter(F.col("inner_place") == 0).select(tree, F.col("block").alias("place"), (F.shiftright(F.col("size") - 1, levels) + 1).alias("size"), F.col("top").alias("digest"))
    above = rooted(tops, tree, levels).select(F.col(tree).alias("_tree"), F.col("place").alias("_block"), F.col("path").alias("_path"), "root")
    joined = done.join(above, done[tree].eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return joined.select(*nodes.columns, F.concat("path", "_path").alias("path"), "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda low, other: F.sha2(F.when(other == "", low).when(other.startswith("L"), F.concat(F.substring(other, 2, 64), low)).otherwise(F.concat(low, F.substring(other, 2, 64))), 256)
    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], altered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """key, group, leaf, told (the leaf with the fields in `altered` replaced), subroot, root, and the path of each row from its leaf to the root."""
    altered = altered or {}
    told = leaf([altered.get(f, F.col(f)) for f in fields])
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("tree"), leaf([F.col(f) for f in fields]).alias("digest"), told.alias("told"))
    rows = rooted(numbered(leaves, ["tree"], ["key"]), "tree", levels)
    rows = written(rows.withColumnRenamed("root", "subroot"), "trees")
    subroots = numbered(rows.filter("place = 0").select(F.col("tree").alias("of"), F.col("subroot").alias("digest")), [], ["of"])
    outer = rooted(subroots.withColumn("tree", F.lit(0)), "tree", levels).select("of", F.col("path").alias("outer"), "root")
    joined = rows.join(outer, rows["tree"].eqNullSafe(outer["of"]))
    return joined.select(F.col("key").alias(key), F.col("tree").alias(group), F.col("digest").alias("leaf"), "told", "subroot", "root", F.concat("path", "outer").alias("path"))


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with proof_sha256 (the siblings end to end), folded_root of what was told, and whether that is the root."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256)
    return rows.withColumns({"proof_sha256": proof, "folded_root": folded(F.col("told"), F.col("path"))}).withColumn("verified", F.col("folded_root") == F.col("root"))
