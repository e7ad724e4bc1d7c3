"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import uuid
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot  # noqa: F401
from ..session import checkpoint_dir, ship_package

BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: A word: a maximal run of letters, digits and underscores (any script).
WORD = re.compile(r"\w+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and
    read it back: lineage is cut, later passes read only the columns they
    need, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch():
    """On leaving, the tables that ``save`` has written inside are deleted, all
    but the last: for a step whose result is written."""
    first = len(_written)
    yield
    for spark, path in _written[first:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[first:-1]


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """``df`` by keys over ``spark.sql.shuffle.partitions`` tasks, and at least
    ``least``.  A stated number: AQE would put groups that are small in bytes
    but long in CPU time into a few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, least), *keys)


def with_workers(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, and let a session that
    says nothing about it send them ``BATCH_ROWS`` rows at a time: rows here
    are whole texts, and both sides hold a batch or two."""
    ship_package(spark)
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    return spark


def text_key(text: Column) -> Column:
    """128-bit key of a text (null stays null)."""
    return F.unhex(F.md5(text))


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(*cols, seed: int = 0) -> Column:
    """A number in (0, 1) from the hash of the columns: 52 random bits."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def slices(batches, rows: int = 1000):
    """Arrow batches cut to so many rows, so that a worker holds few texts as
    Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class Memo(dict):
    """A dictionary of computed values that starts anew when its keys and
    values take ``limit`` bytes, so that a worker's memory stays bounded whatever
    their lengths; results don't depend on what it holds."""

    ENTRY = 104  # of the table itself

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if self.held >= self.limit:
            self.forget()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.held = 0


def tidy(run):
    """``run`` over a task's batches; at its end the worker, which Spark uses
    again for other stages, gives free memory back."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
