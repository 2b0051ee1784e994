"""Keyed tables that are written in versions: an upsert rewrites the buckets that it changes and no others.

A table is a folder. Rows are dealt to buckets by their key; a bucket's files stand in a folder of their own. A version is a small file that
names the folder of each bucket, and it appears at once, by a rename that fails if another writer made that version first.
Readers see one version whole. Files that no version names, as a lost writer leaves them, are never read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.snapshot import latest
from tessera.sources.store import written

BUCKETS = 64


class Conflict(Exception):
    """Another writer made the version first."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, in order; none of a folder that isn't there."""
    _, at, system = _hadoop(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()) for f in system.listStatus(at) if f.getPath().getName().isdigit()) if system.exists(at) else []


def _told(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, told: dict) -> None:
    jvm, at, system = _hadoop(spark, f"{path}/versions/{version}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(at), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        system.delete(draft, False)
        raise Conflict(f"version {version} of {path} is there already") from error


def _rows(spark: SparkSession, path: str, told: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(told["schema"])
    folders = [f"{path}/{folder}" for bucket, folder in sorted(told["folders"].items()) if buckets is None or int(bucket) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one without it."""
    return _rows(spark, path, _told(spark, path, versions(spark, path)[-1] if version is None else version))


def folders(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """The folder of each bucket of a version."""
    return {int(b): f for b, f in _told(spark, path, version)["folders"].items()}


def upsert(path: str, new: DataFrame, keys: list[str], compared: list[str], order: list[str] | None = None, whole: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """SNK-01, SNK-02, SNK-03: bring the rows of new into the table at path, as its next version, and return keys and action of each.

    A key that is there already is updated if a compared column differs, else its old row stays (skipped). With order, of rows of
    one key the last counts; without, keys are unique. Keys that new lacks stay, or go (removed) if new is the whole table. Nulls
    are equal to each other. Only the buckets of new's keys are read, all for a whole table, and only those with a change are
    written; without a change the new version names the old files. A first upsert makes the table and fixes buckets and columns.
    Conflict: another upsert came first; nothing of this one is seen.
    """
    spark = new.sparkSession
    known = versions(spark, path)
    told = _told(spark, path, known[-1]) if known else {"buckets": buckets, "schema": new.schema.jsonValue(), "folders": {}}
    names = [f["name"] for f in told["schema"]["fields"]]
    rows = latest(new.select(names), keys, order) if order else new.select(names)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(told["buckets"])).cast("int")
    rows = written(rows.withColumn("_bucket", bucket), "upsert")
    touched = None if whole else {r[0] for r in rows.select("_bucket").distinct().collect()}
    old = _rows(spark, path, told, touched)
    a = old.select(F.struct(*names).alias("_old"), bucket.alias("_at"))
    b = rows.select(F.struct(*names).alias("_new"), "_bucket")
    on = reduce(lambda x, y: x & y, [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys], F.col("_at") == F.col("_bucket"))
    same = reduce(lambda x, y: x & y, [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in compared], F.lit(True))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "removed" if whole else "kept").when(same, "skipped").otherwise("updated")
    row = F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & same), F.col("_old")).otherwise(F.col("_new"))
    joined = written(a.join(b, on, "full_outer").select(F.coalesce("_bucket", "_at").alias("_bucket"), action.alias("_action"), row.alias("_row")), "upsert")
    changed = sorted(r[0] for r in joined.filter("_action IN ('inserted', 'updated', 'removed')").select("_bucket").distinct().collect())
    if changed:
        folder = f"data/{uuid.uuid4().hex}"
        after = joined.filter(F.col("_bucket").isin(changed) & (F.col("_action") != "removed")).select("_bucket", "_row.*")
        after.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        filled = {r[0] for r in after.select("_bucket").distinct().collect()}
        left = {k: f for k, f in told["folders"].items() if int(k) not in changed}
        told = told | {"folders": left | {str(k): f"{folder}/_bucket={k}" for k in changed if k in filled}}
    _commit(spark, path, known[-1] + 1 if known else 0, told)
    return joined.filter("_action <> 'kept'").select(*[F.col(f"_row.{k}").alias(k) for k in keys], F.col("_action").alias("action"))
