"""Counts (A1-A3): parse rate, stage counts, cluster sizes.

All single aggregations with partial (map-side) aggregation; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import parse_lines
from .similarity import count_similar_pairs


def ingest_stats(lines: DataFrame) -> DataFrame:
    """A1: one row: total, blank, parsed, rejected lines and parse rate."""
    p = parse_lines(lines)
    parsed = F.col("branch").isNotNull()
    return p.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("line").isNull()).alias("blank_lines"),
        F.count_if(parsed).alias("parsed_lines"),
        F.count_if(F.col("line").isNotNull() & ~parsed).alias("rejected_lines"),
        F.round(F.count_if(parsed) / F.count(F.lit(1)), 6).alias("parse_rate"),
    )


def cluster_sizes(members: DataFrame) -> DataFrame:
    """A3: entries per cluster."""
    return members.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))


def stage_stats(lines: DataFrame, clustering) -> DataFrame:
    """A2: one row of stage counts.  ``entries`` are read as the clustering
    wrote them, ``vectors`` are the embedded ones (one for each template).
    Similar pairs are counted where their blocks meet (``count_similar_pairs``)
    and are never rows.  Each count is a scalar subquery over its own frame (no
    join); those of written tables read no column."""
    def n(df):
        return df.select(F.count(F.lit(1))).scalar()

    c = clustering
    return lines.agg(F.count(F.lit(1)).alias("lines")).select(
        "lines",
        n(c.entries).alias("entries"),
        n(c.vectors.where(F.col("vector").isNotNull())).alias("vectors"),
        n(c.templates).alias("templates"),
        count_similar_pairs(c.vectors, "vkey", "vector", c.threshold, c.block_size, c.n_templates).scalar().alias("edges"),
        n(c.clusters).alias("clusters"),
        n(c.clusters.where(F.col("component").isNull())).alias("singleton_clusters"),
    )
