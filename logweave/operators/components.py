"""Connected components (C3) and distributed numbering (C4 helper).

First every task shrinks its own edges to a spanning forest of stars (union by
hooking and pointer jumping on arrays, ``CHUNK`` edges at a time), so what is
shuffled afterwards is bounded by the vertices that tasks have met.  If at most
``LAST`` edges are left, one task shrinks them too and all is done.

More are joined by the alternating *large-star* / *small-star* rounds of
Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
every round is a handful of aggregations and equi-joins on the edge table;
at the fixed point every component is a star around its smallest vertex.
No neighbour list is ever collected.  A round finds each vertex's least
neighbour by partial aggregates and joins it back to the edges; that join
(``join_hot``) sends the vertices of very many edges to the edges, at most 10,000
of them whatever the input, so a hub's edges stay in the tasks that hold them.
Each round's edges are written to the shared checkpoint folder, which cuts lineage
and survives executor loss, and deleted when the next round's are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from .joins import join_hot
from .tables import Written

#: Edges that a task shrinks at a time, and edges that are left to one task.
CHUNK, LAST = 1_000_000, 200_000


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (least vertex, vertex) of the components of edges (a, b)."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(vertices))
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        # Every root is hooked to the least root next to it; then all point to their roots.
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    leaf = np.flatnonzero(parent != np.arange(len(vertices)))
    return vertices[parent[leaf]], vertices[leaf]


def contracted(e: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, with the components of ``e`` (nulls in neither):
    a spanning forest of what each task has."""
    ship_package(e.sparkSession)

    def run(batches):
        held, size = [], 0

        def shrink():
            table = pa.Table.from_batches(held)
            ends = [table.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            stars = spanning_stars(*ends)
            made = pa.RecordBatch.from_arrays([pa.array(x, table.schema.field(0).type) for x in stars], ["a", "b"])
            return made

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                made = shrink()
                if 2 * made.num_rows > CHUNK:  # little left to shrink: pass it on
                    yield made
                    held, size = [], 0
                else:
                    held, size = [made], made.num_rows
        if size:
            yield shrink()

    return e.select("a", "b").mapInArrow(run, e.select("a", "b").schema)


def _canonical(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(
        F.col("a") != F.col("b")
    ).distinct()


def _neighbours(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Connect every larger neighbour of u to the smallest of {u} + N(u)."""
    n = _neighbours(e)
    m = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
    out = join_hot(n.where(F.col("v") > F.col("u")), m, ["u"], F.col("deg"), 2 * edges, "inner").select("v", "m")
    return _canonical(out, "v", "m")


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them."""
    n = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    m = n.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    spokes = join_hot(n, m, ["u"], F.col("deg"), edges, "inner").select("v", "m")
    hub = m.select(F.col("u").alias("v"), "m")
    return _canonical(spokes.unionByName(hub), "v", "m")


def _is_star_forest(e: DataFrame) -> bool:
    """Fixed point: no vertex is both a centre and a leaf, and every leaf
    has exactly one edge."""
    roles = e.select(F.col("a").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("l")).unionByName(
        e.select(F.col("b").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("l"))
    )
    bad = roles.groupBy("n").agg(F.sum("c").alias("c"), F.sum("l").alias("l")).where(
        (F.col("l") > 1) | ((F.col("l") > 0) & (F.col("c") > 0))
    )
    return bad.isEmpty()


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "id",
                         src: str = "i", dst: str = "j", canonical: bool = False) -> DataFrame:
    """``(vid, component)`` where ``component`` is the smallest vertex id
    of the vertex's component (isolated vertices map to themselves).

    ``canonical=True`` declares that ``edges`` already hold each undirected
    edge once as ``src < dst``, which skips a distinct."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")) if canonical else _canonical(edges, src, dst)
    held = Written(contracted(e), "edges")
    # So many edges are left to one task; then they are stars.
    # Every other round shortens some path to a smallest vertex, so this ends.
    while (n := held.df.count()) > LAST and not _is_star_forest(held.df):
        large = Written(_large_star(held.df, n), "edges")
        held.drop()
        held = Written(contracted(_small_star(large.df, large.df.count())), "edges")
        large.drop()
    if n <= LAST:
        last = Written(contracted(held.df.coalesce(1)), "edges")
        held.drop()
        held = last
    e = held.df
    label = e.select(F.col("b").alias("_v"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("_v"), F.col("a").alias("component"))
    ).distinct()
    v = vertices.select(F.col(vid)).distinct()
    return v.join(label, v[vid] == label["_v"], "left").select(
        F.col(vid), F.coalesce(F.col("component"), F.col(vid)).alias("component")
    )


def global_row_number(df: DataFrame, order_cols: list[str], name: str = "row_no",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole frame in ``order_cols`` order,
    without moving all rows into one partition.

    Rows are range-partitioned and sorted; inside a task the generated id
    is consecutive, so a row's number is its task offset (from a table of
    one count per partition - bounded by the partition count and broadcast)
    plus its position.  The sorted rows are checkpointed so both reads see
    the same partitioning.  ``order_cols`` should be unique.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    # Without an explicit count AQE may coalesce adjacent ranges, which keeps
    # the global order (a coalesced task reads whole, consecutive ranges).
    by_range = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    ranged = (
        by_range
        .sortWithinPartitions(*order_cols)
        .select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
        .checkpoint()
    )
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    pos = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return ranged.join(F.broadcast(offsets), "_p").select(
        *df.columns, (F.col("_off") + pos + 1).alias(name)
    )
