"""Snapshots: keyed upserts, version and line differences, set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """SNK-01, SNK-02: the keys of two snapshots with `action`: inserted, updated (a compared column differs), skipped or
    removed. Nulls are equal to each other."""
    a = old.select(*keys, F.struct(*compared).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*compared).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return a.join(b, list(keys), "full_outer").select(*keys, action.alias("action"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SNK-03, SNK-05, TOP-06: the last row of each key by order, as one aggregate that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def version_diff(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """JOI-12: key, kind (added, removed, version_changed), old and new of what differs."""
    a, b = before.select(key, F.col(version).alias("old"), F.lit(1).alias("_a")), after.select(key, F.col(version).alias("new"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "version_changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind"), "old", "new").filter(F.col("kind").isNotNull())


def line_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """JOI-13: key, line (from 1), action (remove or add) and content; lines are compared at the same place only."""
    lines = F.arrays_zip(F.split(before, "\n").alias("a"), F.split(after, "\n").alias("b"))
    each = pairs.select(key, F.posexplode(lines).alias("n", "z")).filter(~F.col("z.a").eqNullSafe(F.col("z.b")))
    acts = F.array(F.struct(F.lit("remove").alias("action"), F.col("z.a").alias("content")), F.struct(F.lit("add").alias("action"), F.col("z.b").alias("content")))
    return each.select(key, (F.col("n") + 1).alias("line"), F.inline(acts)).filter(F.col("content").isNotNull())


def repeats(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """AGG-06 by row: every row of a key after the first by order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_place", place).filter("_place > 1").drop("_place")
