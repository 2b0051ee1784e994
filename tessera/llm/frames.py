"""Arrow-batched columns beside those that a frame has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STEP_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and Python, where a count of rows alone would let long texts fill memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bounded closer."""
    value = spark.conf.get(BATCH_SETTING, None)
    if value is None or not value.isdigit() or not 0 < int(value) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def steps(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, so that what is made of one stays small too."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, size))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def with_arrays(df: DataFrame, compute: Callable[[pa.RecordBatch], list], fields: list[T.StructField], drop: tuple[str, ...] = (), size: int = STEP_BYTES) -> DataFrame:
    """df with the columns that `compute` makes of each Arrow batch, `size` bytes at a time.

    Columns of df with the name of a new one go, and those in `drop`, after use.
    """
    bounded(df.sparkSession)
    names = {f.name.lower() for f in fields} | {x.lower() for x in drop}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + compute(batch), names=labels)

    return df.mapInArrow(run, schema)


def column(df: DataFrame, name: str) -> int:
    """The place of the column called name."""
    return df.columns.index(name)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
