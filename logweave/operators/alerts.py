"""Alert rows (D3).  Only declared by the reference; the rules are ours:
severity is the worst level in the cluster (FATAL -> CRITICAL, ERROR ->
HIGH, WARN -> MEDIUM, else LOW), the summary is the result's pattern, the
long summary its root cause, and the affected services are the distinct
services of the cluster's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def build_alerts(results: DataFrame, assigned: DataFrame) -> DataFrame:
    """One alert per result row, from entries that carry their
    ``cluster_no`` (``Clustering.assigned``).  One pass over the entries: a
    hash aggregate by ``(cluster, service)`` keeps the level flags, a second
    one by cluster joins them, so each collected list is bounded by the
    number of distinct services, not by the cluster's row count."""
    per_service = assigned.groupBy("cluster_no", "service").agg(
        *[F.max((F.col("level") == lv).cast("int")).alias(f"_{lv}") for lv, _ in fixed.SEVERITY_BY_LEVEL]
    )
    flags = per_service.groupBy("cluster_no").agg(
        *[F.max(f"_{lv}").alias(f"_{lv}") for lv, _ in fixed.SEVERITY_BY_LEVEL],
        F.array_sort(F.collect_list("service")).alias("affected_services"),
    )
    sev = F.lit("LOW")
    for lv, s in reversed(fixed.SEVERITY_BY_LEVEL):
        sev = F.when(F.col(f"_{lv}") == 1, F.lit(s)).otherwise(sev)
    return (
        results.select("cluster_no", "error_pattern", "root_cause")
        .join(flags, "cluster_no")
        .select(
            "cluster_no",
            sev.alias("severity"),
            F.col("error_pattern").alias("summary"),
            "affected_services",
            F.col("root_cause").alias("llm_summary"),
            F.localtimestamp().alias("detected_at"),
        )
    )


def severity_rank(level) -> Column:
    """3 for the worst level that alerts, down to 1; 0 for all others."""
    n = len(fixed.SEVERITY_BY_LEVEL)
    out = F.lit(0)
    for k, (lv, _) in reversed(list(enumerate(fixed.SEVERITY_BY_LEVEL))):
        out = F.when(F.col(level) == lv, n - k).otherwise(out)
    return out


def escalations(entries: DataFrame, key: str, silence: str = "30 minutes", time: str = "ts") -> DataFrame:
    """``(key, at, severity)``: one alert for each rise of a key's severity
    above what was told since it was last silent for more than ``silence``.

    Within a session window a severity is told at its first entry unless a
    higher one came before or with it, so the first times of the severities
    are all that is needed: partial aggregates, no ordered pass over a key."""
    ranks = range(1, len(fixed.SEVERITY_BY_LEVEL) + 1)
    t = entries.select(key, time, severity_rank("level").alias("_rank")).where(F.col(time).isNotNull() & (F.col("_rank") > 0))
    g = t.groupBy(key, F.session_window(time, silence).alias("_w")).agg(*[F.min(F.when(F.col("_rank") == r, F.col(time))).alias(f"_{r}") for r in ranks])
    names = [s for _, s in reversed(fixed.SEVERITY_BY_LEVEL)]
    told = []
    for r in ranks:
        above = [F.col(f"_{x}").isNull() | (F.col(f"_{r}") < F.col(f"_{x}")) for x in ranks if x > r]
        first = F.col(f"_{r}").isNotNull()
        for c in above:
            first = first & c
        told.append(F.when(first, F.struct(F.col(f"_{r}").alias("at"), F.lit(names[r - 1]).alias("severity"))))
    return g.select(key, F.explode(F.array_compact(F.array(*told))).alias("x")).select(key, "x.at", "x.severity")
