"""Tables in the shared folder that the session names, and writers of snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is set, as in tests, a temporary one for this session."""
    if not (found := spark.conf.get(SETTING, None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps start from it even if executors are lost."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
