"""Deduplication (D2, declared only by the reference; rules are ours).

Batch: keep the first entry (lowest ``(source, line_no)``) of each key
group and count the copies.  Hash aggregation with map-side partial
aggregates (``first_per_group``), so a key holding a third of all rows
costs one partial row per task and no task sorts its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(keys..., source, line_no, keep..., dup_count)``."""
    from .firsts import first_keys, first_per_group

    keep = [c for c in df.columns if c not in keys and c not in ("source", "line_no")] if keep is None else keep
    if not keep:
        # Only the order key is kept: one pass of hash aggregates, no fetch.
        f = first_keys(df, keys)
        return f.select(*keys, F.col("_s").alias("source"), F.col("_l").alias("line_no"),
                        F.col("n").alias("dup_count"))
    g = first_per_group(df, keys, ["source", "line_no", *keep])
    return g.withColumnRenamed("n", "dup_count")


def dedupe_within(df: DataFrame, keys: list[str], within: str, time: str = "ts") -> DataFrame:
    """``(keys..., first_ts, last_ts, dup_count)``: repeats of a key count as
    one as long as each comes at most ``within`` after the one before it (a
    session window).  Entries of a key without a time are one group with NULL
    times (``untimed_repeats``), so every entry is in some ``dup_count``."""
    return timed_repeats(df, keys, within, time).unionByName(untimed_repeats(df, keys, time))


def timed_repeats(df: DataFrame, keys: list[str], within: str, time: str = "ts") -> DataFrame:
    """The groups of entries that have a time."""
    t = df.where(F.col(time).isNotNull())
    g = t.groupBy(*keys, F.session_window(time, within).alias("_w")).agg(
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("dup_count"))
    return g.select(*keys, "first_ts", "last_ts", "dup_count")


def untimed_repeats(df: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """The groups of entries without a time."""
    g = df.where(F.col(time).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count"))
    none = F.lit(None).cast(df.schema[time].dataType)
    return g.select(*keys, none.alias("first_ts"), none.alias("last_ts"), "dup_count")
