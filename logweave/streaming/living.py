"""Clusters that live across micro-batches.

A state table keeps every template met so far with its number and the number
of its cluster, which is that of the cluster's oldest template.  A micro-batch
adds only its new templates: they are compared with each other and with the known
ones, and joined to the known clusters by components over the stars of the known
and the new similar pairs.  So a cluster keeps its number when it grows, and when
two clusters meet, the older number stays.

The state is a folder for each batch below ``path``; batch ``n`` reads the last
one before it and replaces its own.  A batch that failed or is run again after a
restart therefore gives the same numbers and the same rows.  State is one row
for each template, not for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.components import connected_components, global_row_number
from ..operators.features import embed_templates
from ..operators.firsts import first_keys
from ..operators.ingest import ingest
from ..operators.joins import join_hot
from ..operators.similarity import similar_between, similar_pairs
from ..operators.tables import Written
from ..plans.analyze import templated
from ..sources.logs import number_lines

STATE = "template string, k1 bigint, k2 bigint, vkey bigint, vector array<float>, cluster_id bigint, n bigint"


class LivingClusters:
    """``update`` takes a micro-batch in and returns its entries with their
    ``cluster_id``; ``clusters`` reads the state."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = fixed.SIMILARITY_THRESHOLD, block_size: int = 2048):
        self.spark, self.path, self.threshold, self.block_size = spark, path, threshold, block_size

    def _folders(self) -> dict[int, str]:
        """Finished states by batch number."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [str(s.getPath().getName()) for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [f for f in found if f.startswith("batch=") and fs.exists(fs_path(f"{self.path}/{f}/_SUCCESS"))]
        return {int(f.removeprefix("batch=")): f"{self.path}/{f}" for f in done}

    def state(self, before: int | None = None) -> DataFrame:
        """The last state, or the last one before a batch; empty at first."""
        folders = {n: f for n, f in self._folders().items() if before is None or n < before}
        if not folders:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(folders[max(folders)])

    def clusters(self) -> DataFrame:
        """``(cluster_id, templates, size)``."""
        return self.state().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("templates"), F.sum("n").alias("size"))

    def update(self, lines: DataFrame, batch_id: int) -> DataFrame:
        """Lines of a micro-batch -> its entries with ``cluster_id`` (NULL for
        entries without a template, each a cluster of its own).  A micro-batch of a
        file stream (``read_log_stream``) is numbered first."""
        if "block_start" in lines.columns:
            lines = number_lines(lines.drop("pos", "line_no"))
        held = Written(templated(ingest(lines)), "entries")
        known = self.state(before=batch_id)
        met = first_keys(held.df.where(F.col("k1").isNotNull()), ["template", "k1", "k2"]).select("template", "k1", "k2", "n", "_s", "_l")
        new = met.join(known.select("k1", "k2"), ["k1", "k2"], "left_anti")
        top = known.agg(F.coalesce(F.max("vkey"), F.lit(0))).first()[0]
        # Numbers in order of first lines, after all that are known.
        numbered = global_row_number(new, ["_s", "_l", "template"], "_no").withColumn("vkey", F.col("_no") + F.lit(top))
        fresh = Written(numbered.select("template", "k1", "k2", "vkey", embed_templates("template").alias("vector"), "n"), "templates")
        pairs = similar_pairs(fresh.df, "vkey", "vector", self.threshold, self.block_size, forest=True)
        if top:
            pairs = pairs.unionByName(similar_between(fresh.df, known, "vkey", "vector", self.threshold, self.block_size, forest=True))
        stars = known.where("vkey <> cluster_id").select(F.col("cluster_id").alias("i"), F.col("vkey").alias("j"))
        everyone = known.select("vkey").unionByName(fresh.df.select("vkey")).withColumnRenamed("vkey", "id")
        comp = connected_components(everyone, pairs.select("i", "j").unionByName(stars), canonical=True)
        rows = known.drop("cluster_id").unionByName(fresh.df.withColumn("n", F.lit(0).cast("long")))
        counted = rows.join(met.select("k1", "k2", F.col("n").alias("_n")), ["k1", "k2"], "left").withColumn("n", F.col("n") + F.coalesce("_n", F.lit(0)))
        state = counted.join(comp.select(F.col("id").alias("vkey"), F.col("component").alias("cluster_id")), "vkey")
        state.select([c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch_id)}")
        fresh.drop()
        now = self.state(before=batch_id + 1).select("k1", "k2", "cluster_id")
        weighed = met.select("k1", "k2", F.col("n").alias("_n")).join(now, ["k1", "k2"])
        total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out = join_hot(held.df, weighed, ["k1", "k2"], F.col("_n"), total)
        return out.drop("k1", "k2", "_n")


def cluster_stream(lines_stream: DataFrame, living: LivingClusters, write, checkpoint_location: str, trigger: dict | None = None):
    """Run ``living.update`` on every micro-batch and hand its entries to
    ``write(entries, batch_id)``.  Returns the started query."""
    w = lines_stream.writeStream.foreachBatch(lambda df, n: write(living.update(df, n), n)).option("checkpointLocation", checkpoint_location)
    return w.trigger(**(trigger or {"availableNow": True})).start()
