"""Result sinks (S4-S6): JSON objects, paged JSON arrays, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_local, json_escape


def _s(c):
    return F.concat(F.lit('"'), json_escape(F.coalesce(F.col(c), F.lit(""))), F.lit('"'))


def result_json(with_time: bool = False):
    """S4 as a column: ``{"errorPattern","rootCause","fixSuggestion",
    "confidenceScore"[,"analyzedAt"]}`` in that order; NULL text -> ``""``."""
    parts = [
        F.lit('{"errorPattern":'), _s("error_pattern"),
        F.lit(',"rootCause":'), _s("root_cause"),
        F.lit(',"fixSuggestion":'), _s("fix_suggestion"),
        F.lit(',"confidenceScore":'), F.col("confidence_score").cast("string"),
    ]
    if with_time:
        parts += [F.lit(',"analyzedAt":"'), iso_local("analyzed_at"), F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def results_to_json(results: DataFrame, with_time: bool = False) -> DataFrame:
    return results.select("cluster_no", result_json(with_time).alias("json"))


def write_results_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 sink: one JSON object per line (``analyzedAt`` stamped at write)."""
    out = results.withColumn("analyzed_at", F.localtimestamp())
    results_to_json(out, with_time=True).select("json").write.mode(mode).text(path)


def write_results_batch(results: DataFrame, path: str, batch_id: int) -> None:
    """S4 sink of a stream's micro-batches, exactly once: batch ``n`` owns the
    folder ``batch=n`` below ``path`` and replaces what is there, so a batch that
    failed half-way or is run again after a restart leaves its results once.
    Spark's committer shows a folder's files only when all are written."""
    write_results_json(results, f"{path}/batch={int(batch_id)}")


def read_results_json(spark, path: str) -> DataFrame:
    """What ``write_results_batch`` wrote: ``(batch, json)``."""
    return spark.read.option("basePath", path).text(f"{path}/batch=*").select(F.col("batch").cast("long").alias("batch"), F.col("value").alias("json"))


def results_json_pages(results: DataFrame, page_size: int = 1000, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """The result list as JSON arrays in ``cluster_no`` order, one row
    per page of at most ``page_size`` results (never one global array), for
    each group of ``group_cols``."""
    timed = "analyzed_at" in results.columns
    j = results.select(
        *group_cols, ((F.col("cluster_no") - 1) / page_size).cast("long").alias("page_no"),
        "cluster_no", result_json(timed).alias("_j"),
    )
    return j.groupBy(*group_cols, "page_no").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_no", "_j"))), lambda x: x["_j"]), ","),
            F.lit("]"),
        ).alias("json"),
    )


def report_rows(results: DataFrame) -> DataFrame:
    """``Cluster n of N``, texts with ``N/A`` for NULL, confidence as a
    whole percent, and when it was analysed (the ``analyzed_at`` column, else
    now).  ``N`` is a scalar subquery (one aggregate, no join)."""
    at = F.col("analyzed_at") if "analyzed_at" in results.columns else F.localtimestamp()
    total = results.select(F.count(F.lit(1))).scalar()
    return results.select(
        "cluster_no",
        F.format_string("Cluster %d of %d", F.col("cluster_no"), total).alias("heading"),
        F.coalesce("error_pattern", F.lit("N/A")).alias("pattern"),
        F.coalesce("root_cause", F.lit("N/A")).alias("root_cause"),
        F.coalesce("fix_suggestion", F.lit("N/A")).alias("fix_suggestion"),
        F.format_string("%.0f%%", F.col("confidence_score") * 100).alias("confidence"),
        iso_local(at).alias("analyzed_at"),
    )
