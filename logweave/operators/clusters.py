"""Cluster-level operators (C6, C7): entry lookup, small-cluster flag.
Representatives (C8) are columns of the cluster table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def join_entries(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Fetch each member's entry (equi-join on ``id``; sort-merge or
    AQE broadcast, both sides keyed by a unique id, so no skew)."""
    return members.select("cluster_no", "cluster_label", "id").join(entries, "id")


def flag_small(clusters: DataFrame, size_col: str = "size", n: int = fixed.SMALL_CLUSTER_SIZE) -> DataFrame:
    """``low_confidence`` when a cluster has fewer than ``n`` entries."""
    return clusters.withColumn("low_confidence", F.col(size_col) < n)
