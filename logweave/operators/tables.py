"""Tables written below the shared checkpoint folder to cut lineage.

Written as Parquet rather than with ``checkpoint()``: later passes read only
the columns they need, a count reads no rows, and the table can be deleted when
its last reader is done."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


class Written:
    """A written table: ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark: SparkSession = df.sparkSession
        self.path = os.path.join(checkpoint_dir(self.spark), f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
