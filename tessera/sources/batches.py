"""Arrow batches of bounded size between Spark and Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, where a count of rows alone would let long texts fill memory.
SETTING, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20
STEP = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bounded closer."""
    value = spark.conf.get(SETTING, None)
    if value is None or not value.isdigit() or not 0 < int(value) <= BYTES:
        spark.conf.set(SETTING, str(BYTES))


def slices(batches: Iterator[pa.RecordBatch], size: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, so that what is made of one stays small too."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, size))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
