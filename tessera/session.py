"""Session factory, table reader and the folder for intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; conf adds or replaces settings."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


#: Rows of a table that one task works on where its file is small and much is made of each row.
ROWS = 20_000


def spread(rows: DataFrame, key: str, each: int = ROWS) -> DataFrame:
    """The rows dealt to tasks of about `each` of them by a key. A small file with many rows is read by one task, which would then make all
    that follows from them alone; the number of tasks grows with the rows. Counting them reads no column."""
    n = -(-rows.count() // each)
    return rows.repartition(n, key) if n > rows.rdd.getNumPartitions() else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
