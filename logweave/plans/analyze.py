"""End-to-end plan (R12): lines -> entries -> templates -> vectors ->
similar pairs -> components -> numbered clusters -> one result per cluster.

Scale notes
-----------
* Parsing and templating are one narrow stage over the lines; its result is
  written once as Parquet to the shared checkpoint folder, and the consumers
  read only the columns they need.
* Equal non-empty templates have equal vectors (cosine 1), so the quadratic
  step runs over *distinct templates*, never over lines.  The template table
  is a hash aggregate with partial aggregation: a template holding a third
  of all rows costs one partial row per task.
* Components need no table of all similar pairs: every group of the
  similarity join returns a spanning forest.
* Empty templates (NULL, blank or symbol-only messages) have zero vectors,
  which are similar to nothing: each such entry is its own cluster and
  never enters the similarity join.
* Templates are vertices under a dense number; entries find their cluster by a
  128-bit key of the template (two longs), without a hot key (``join_hot``).
* Clusters are numbered by their representative (lowest ``(source,
  line_no)``) with a distributed row number, not a one-partition window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import message_template
from ..operators.components import connected_components, global_row_number
from ..operators.features import embed_templates
from ..operators.firsts import fetch_rows, first_keys
from ..operators.joins import join_hot
from ..operators.rca import classify, empty_cluster_result
from ..operators.similarity import similar_pairs
from ..operators.tables import Written

# Order key first: min(struct) picks the lowest (source, line_no) and
# carries the whole entry along.
REP = ["source", "line_no", "id", "ts", "level", "service", "message", "raw_line"]


@dataclass
class Clustering:
    entries: DataFrame    # REP columns, template, k1, k2
    templates: DataFrame  # template, k1, k2, n, first (struct source, line_no), vkey, component
    vectors: DataFrame    # vkey, vector
    clusters: DataFrame   # cluster_no, cluster_label, component, rep_*, size
    members: DataFrame    # cluster_no, cluster_label, id, source, line_no
    assigned: DataFrame   # every entry column + template, cluster_no, cluster_label
    threshold: float
    block_size: int
    n_templates: int
    written: tuple        # the tables below the checkpoint folder

    @cached_property
    def edges(self) -> DataFrame:
        """All similar template pairs (i, j, cosine), which clustering itself
        does not need."""
        pairs = Written(similar_pairs(self.vectors, "vkey", "vector", self.threshold, self.block_size, self.n_templates), "pairs")
        self.written += (pairs,)
        return pairs.df

    def release(self) -> None:
        """Delete the written tables once ``entries``, ``templates``,
        ``vectors``, ``members`` and ``assigned`` are no longer read; ``clusters``
        stays readable."""
        for w in self.written:
            w.drop()


def templated(entries: DataFrame) -> DataFrame:
    """Entries with ``template`` and its 128-bit key ``(k1, k2)`` (NULL for
    the zero vectors of empty templates)."""
    t = entries.select(*REP, message_template("message").alias("template"))
    some = F.length("template") > 0
    return t.withColumns({"k1": F.when(some, F.xxhash64("template")), "k2": F.when(some, F.xxhash64(F.lit(1), "template"))})


def cluster_entries(entries: DataFrame, threshold: float = fixed.SIMILARITY_THRESHOLD, block_size: int = 2048,
                    embed=None, similar=None) -> Clustering:
    """Cluster entries.

    ``embed`` (template column -> vector column) and ``similar`` (vectors
    ``(vkey, vector)`` -> pairs ``(i, j, cosine)``, of which only the
    components count) replace the built-in vectors and similarity, e.g.
    ``similar=lambda v: similar_pairs_approx(v, "vkey", "vector", 0.85,
    forest=True)``."""
    held = Written(templated(entries), "entries")
    et = held.df

    # Template table by hash aggregation only (see operators/firsts.py):
    # count and the first (source, line_no) of every template.
    counted = first_keys(et.where(F.col("k1").isNotNull()), ["template", "k1", "k2"]).select(
        "template", "k1", "k2", "n", F.struct(F.col("_s").alias("source"), F.col("_l").alias("line_no")).alias("first"))
    numbered = global_row_number(counted, ["template"], "vkey")
    # Embedded once and written with their vectors; readers take the columns they need.
    all_templates = Written(numbered.withColumn("vector", (embed or embed_templates)("template")), "templates")
    templates, vectors = all_templates.df.drop("vector"), all_templates.df.select("vkey", "vector")
    n_templates, n_rows = templates.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if similar is None:
        forest = similar_pairs(vectors, "vkey", "vector", threshold, block_size, n_templates, forest=True)
    else:
        forest = similar(vectors).select("i", "j").distinct()
    comp = connected_components(templates.select(F.col("vkey").alias("id")), forest, canonical=similar is None)
    tc = templates.join(comp.withColumnRenamed("id", "vkey"), "vkey")

    # One row per component: its first entry, fetched by an equi-join.
    comp_first = tc.groupBy("component").agg(F.min("first").alias("_k"), F.sum("n").alias("size")).select(
        "component", "size", F.col("_k.source").alias("_s"), F.col("_k.line_no").alias("_l"))
    from_templates = fetch_rows(et, comp_first).select("component", F.struct(*REP).alias("rep"), "size")
    singles = et.where(F.col("k1").isNull()).select(
        F.lit(None).cast("long").alias("component"), F.struct(*REP).alias("rep"), F.lit(1).cast("long").alias("size")
    )
    clusters = from_templates.unionByName(singles).select(
        "component", *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in REP], "size",
    )
    # Its rows are checkpointed by global_row_number, so results don't read the entries again.
    numbered = global_row_number(clusters, ["rep_source", "rep_line_no"], "cluster_no").withColumn(
        "cluster_label", F.concat(F.lit("Cluster-"), F.col("cluster_no").cast("string"))
    )

    # Template key -> cluster number.  Templates on very many rows, counted
    # above, are sent to the entries; only the others are shuffled (join_hot).
    t2c = tc.select("k1", "k2", "component", "n").join(
        numbered.where(F.col("component").isNotNull()).select("component", "cluster_no"),
        "component",
    ).select("k1", "k2", "cluster_no", F.col("n").alias("_n"))
    # Entries keep all their columns: consumers (samples, alerts, entry
    # lookups) read this frame instead of joining members back to entries.
    assigned = (
        join_hot(et.where(F.col("k1").isNotNull()), t2c, ["k1", "k2"], F.col("_n"), n_rows, "inner")
        .select(*REP, "template", "cluster_no",
                F.concat(F.lit("Cluster-"), F.col("cluster_no").cast("string")).alias("cluster_label"))
        .unionByName(
            numbered.where(F.col("component").isNull()).select(
                *[F.col(f"rep_{c}").alias(c) for c in REP],
                F.lit(None).cast("string").alias("template"), "cluster_no", "cluster_label",
            )
        )
    )
    members = assigned.select("cluster_no", "cluster_label", "id", "source", "line_no")
    return Clustering(et, tc, vectors, numbered, members, assigned, threshold, block_size, n_templates, (held, all_templates))


def resolve(clusters: DataFrame, replies: DataFrame | None = None, classify_fn=None) -> DataFrame:
    """One result per cluster, in both modes.

    A cluster without entries (``size`` 0 or no representative, possible for
    caller-supplied cluster tables) gets the empty-cluster result, whatever
    the mode.  Otherwise a received reply is parsed (even a bad one keeps its
    parse result), and without one the rules decide: ``classify_fn``
    (clusters -> clusters with the four result columns), by default the
    built-in rules on the representative's message.  ``replies`` is
    ``(cluster_no, response)`` with unique ``cluster_no``, or None (offline).
    ``source`` says ``empty``, ``reply`` or ``rules``."""
    c = (classify_fn or (lambda d: classify(d, msg="rep_message")))(clusters)
    if replies is None:
        return finished(c, offline=True)
    r = replies.select(F.col("cluster_no").alias("_no"), F.col("response").alias("_response"), F.lit(True).alias("_got"))
    return finished(c.join(r, F.col("cluster_no") == F.col("_no"), "left").withColumn("_got", F.coalesce("_got", F.lit(False))))


def finished(c: DataFrame, offline: bool = False) -> DataFrame:
    """The results of clusters with their rules' columns and, unless
    ``offline``, ``_got`` (whether a reply came) and ``_response``.  Offline the
    plan has no reply parser in it, which would cost more planning than a small
    analysis takes."""
    from ..operators.prompts import parse_reply, reply_text

    empty = (F.coalesce(F.col("size"), F.lit(0)) == 0) | F.col("rep_id").isNull()
    e = empty_cluster_result()
    source = F.when(empty, "empty")
    if not offline:
        c = c.withColumn("_p", parse_reply(reply_text("_response")))
        source = source.when(F.col("_got"), "reply")

    def pick(name):
        value = F.when(empty, e[name])
        if offline:  # NULL like a reply's, for one schema in both modes
            value = value.when(F.lit(False), F.lit(None))
        else:
            value = value.when(F.col("_got"), F.col("_p")[name])
        return value.otherwise(F.col(name)).alias(name)

    return c.select(
        "cluster_no",
        F.concat_ws(":", "cluster_label", F.when(empty, e["rep_id"]).otherwise(F.col("rep_id"))).alias("log_entry_id"),
        source.otherwise("rules").alias("source"),
        pick("error_pattern"), pick("root_cause"), pick("fix_suggestion"), pick("confidence_score"),
        "size",
    )


def heuristic_results(clusters: DataFrame, classify_fn=None) -> DataFrame:
    """The results without replies."""
    return resolve(clusters, None, classify_fn)


def analyze(lines: DataFrame, replies: DataFrame | None = None, *, ingest_fn=None, cluster_fn=None,
            classify_fn=None, embed=None, similar=None, threshold: float = fixed.SIMILARITY_THRESHOLD) -> DataFrame:
    """Raw lines -> one result row per cluster.

    ``replies=None`` is the offline mode (keyword rules only); otherwise
    ``replies(cluster_no, response)`` are parsed and clusters without a reply
    fall back to the rules.  ``ingest_fn`` (lines -> entries), ``cluster_fn``
    (entries -> Clustering), ``embed`` and ``similar`` (see
    ``cluster_entries``) and ``classify_fn`` (see ``resolve``) replace the
    built-in steps.  The entries written on the way are deleted; the result
    reads checkpointed clusters only.
    """
    from ..operators.ingest import ingest

    entries = (ingest_fn or ingest)(lines)
    c = (cluster_fn or (lambda e: cluster_entries(e, threshold, embed=embed, similar=similar)))(entries)
    result = resolve(c.clusters, replies, classify_fn)
    if cluster_fn is None:
        c.release()
    return result
