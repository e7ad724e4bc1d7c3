"""Table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of every table read over so many tasks.
SCAN_TASKS = "spark.logweave.scanTasks"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.  How many tasks scan it is up to the split settings
    (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``), which
    can't cut inside a row group.  For a table in one small row group a caller
    may set ``SCAN_TASKS``; without it no rows are dealt anew."""
    df = spark.read.parquet(path)
    n = spark.conf.get(SCAN_TASKS, None)
    return df.repartition(int(n)) if n else df
