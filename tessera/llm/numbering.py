"""Places of rows in their groups, however large a group is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import unused
from tessera.llm.store import written


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """rows with their place from 0 in their group, by order with nulls first, and the size of the group; no groups: among all.

    Rows are dealt by ranges of group and order, so a large group stands in many parts; a part's rows are numbered on
    their own and moved on by what the parts before it hold. Rows that tie are numbered in the order they are read in.
    `rows` is written first, as the ranges come from a sample of it, and so is what the places are taken from.
    """
    part, tie = unused(rows, "part"), unused(rows, "tie")
    kept = written(rows.withColumn(tie, F.monotonically_increasing_id()), "rows")
    dealt = kept.repartitionByRange(*group, *order, tie).withColumn(part, F.spark_partition_id())
    dealt = written(dealt, "parts")
    counts = dealt.groupBy(part, *group).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(over.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(F.col(part).alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in group], F.coalesce(before, F.lit(0)).alias("moved"), F.sum("n").over(over).alias("total"))
    local = F.row_number().over(Window.partitionBy(part, *group).orderBy(*order, tie)) - 1
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group], F.col(part) == F.col("of_part"))
    out = dealt.withColumn("local", local).join(moved, on)
    return out.select(*rows.columns, (F.col("local") + F.col("moved")).cast("long").alias(place), F.col("total").alias(size))
