"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most.
MOST = 10_000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], weight: Column, total: float, how: str = "left", most: int = MOST) -> DataFrame:
    """``rows`` joined to ``table`` (keys once each) without a hot key.

    ``weight`` of a key is at least in proportion to its rows in ``rows``, and
    the weights of ``table`` add up to ``total`` at most.  So at most ``most``
    keys weigh more than ``total / most``: these are broadcast, and the rows
    without them, none of whose keys is hot, are shuffled.  Key columns are
    those of ``rows``, followed by the other columns of ``table``."""
    heavy = weight * F.lit(float(most)) > F.lit(float(total))
    new = [c for c in table.columns if c not in on]
    near = rows.join(F.broadcast(table.where(heavy).withColumn("_hot", F.lit(True))), on, "left")
    hot = near.where("_hot").select(*rows.columns, *new)
    rest = near.where("_hot IS NULL").select(*rows.columns).join(table.where(~heavy), on, how)
    return hot.unionByName(rest.select(*rows.columns, *new))
