"""Approximate nearest neighbours by a robust-pruned directed graph (Vamana).

Rows are dealt by hash into shards of about ``SHARD`` vectors.  In a shard, equal
vectors are one node.  The graph begins at random; nodes in random order,
many at a time, search greedily for themselves from the shard's centre, and
the nodes visited, with their present neighbours, are proposed.  Robust pruning
keeps the nearest, drops what ``alpha`` times its distance from a kept one does
not exceed its distance from the node, and repeats, up to ``DEGREE`` neighbours;
edges are added backwards and pruned likewise.  Two rounds, with alpha 1 and
1.2.  Nodes that can't be reached are linked from their nearest reachable.

A block of queries meets each shard: beam search gives the nodes, distances
are computed again on the original vectors, and the shards' answers are merged,
ties to the smaller id.  All distances are in double precision, within a shard in
units of its middle vector, so one vector far out spoils nothing.  A beam that
holds less than k other ids, as one id may have many vectors, is widened.

Defined cases: vectors that are null, empty or zero, hold null or non-finite
components, or whose id is null, take no part.  Rows equal in id and vector
count once; an id with several vectors is answered once, by its nearest.
Vectors of different lengths never meet.  A query with fewer candidates gets
all of them.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, save, with_workers

SHARD, DEGREE, BEAM, SEARCH_BEAM, BATCH, QUERIES = 4096, 24, 48, 128, 256, 1024


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of x (b, d) to y (b, c, d)."""
    diff = y - x[:, None, :]
    return np.einsum("bcd,bcd->bc", diff, diff)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, visits: bool = False):
    """Best-first search of all queries at once.  Returns the beam (ids and
    squared distances, nearest first; -1 and inf where empty), and with
    ``visits`` the nodes expanded and their distances."""
    b, n = len(queries), len(points)
    ids = np.full((b, beam), -1, np.int32)
    far = np.full((b, beam), np.inf)
    opened = np.zeros((b, beam), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], seen[:, start] = start, True
    far[:, 0] = distances(queries, points[start][None, None, :])[:, 0]
    log_ids, log_far = [], []
    while True:
        todo = np.where(opened | (ids < 0), np.inf, far)
        at = todo.argmin(axis=1)
        rows = np.flatnonzero(np.isfinite(todo[np.arange(b), at]))
        if not len(rows):
            break
        at = at[rows]
        node = ids[rows, at]
        opened[rows, at] = True
        if visits:
            one, two = np.full(b, -1, np.int32), np.full(b, np.inf)
            one[rows], two[rows] = node, far[rows, at]
            log_ids.append(one)
            log_far.append(two)
        near = graph[node]
        new = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = True
        d = np.where(new, distances(queries[rows], points[np.maximum(near, 0)]), np.inf)
        every = np.concatenate([far[rows], d], axis=1)
        order = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        far[rows] = np.take_along_axis(every, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], axis=1), order, 1)
        opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros(new.shape, bool)], axis=1), order, 1)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    return (ids, far, np.array(log_ids).T, np.array(log_far).T) if visits else (ids, far)


def robust_prune(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours (-1 fills up) of each node from its proposals ``ids``."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for a in range(0, len(nodes), 128):
        own, cand = nodes[a : a + 128], ids[a : a + 128]
        cand = np.sort(cand, axis=1)
        ok = (cand >= 0) & (cand != own[:, None])
        ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        x = points[np.maximum(cand, 0)]
        d = np.where(ok, distances(points[own], x), np.inf)
        norm = np.einsum("bcd,bcd->bc", x, x)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        rows = np.arange(len(own))
        for k in range(degree):
            best = d.argmin(axis=1)
            alive = np.isfinite(d[rows, best])
            if not alive.any():
                break
            out[a + rows[alive], k] = cand[rows[alive], best[alive]]
            d[(alpha * alpha * between[rows, best] <= d) & alive[:, None]] = np.inf
            d[rows, best] = np.inf
    return out


def _add_back(points: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Add the reverse of the nodes' edges; prune where there is no room."""
    degree = graph.shape[1]
    src = np.repeat(nodes, degree)
    dst = graph[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    to, first, count = np.unique(dst, return_index=True, return_counts=True)
    wide = np.full((len(to), degree + int(count.max(initial=0))), -1, np.int32)
    wide[:, :degree] = graph[to]
    wide[np.repeat(np.arange(len(to)), count), degree + np.arange(len(dst)) - np.repeat(first, count)] = src
    wide = np.sort(wide, axis=1)[:, ::-1]
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    wide = np.sort(wide, axis=1)[:, ::-1]
    full = (wide >= 0).sum(axis=1) > degree
    graph[to[~full]] = wide[~full][:, :degree]
    if full.any():
        graph[to[full]] = robust_prune(points, to[full], wide[full], alpha, degree)


def _reached(graph: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(graph), bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        near = np.unique(graph[front])
        front = near[(near >= 0) & ~seen[near]]
        seen[front] = True
    return seen


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 0) -> tuple[np.ndarray, int]:
    """The graph of different points, and the node to start at."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int(((points - np.median(points, axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        graph[graph == np.arange(n)[:, None]] = -1
    for alpha in (1.0, 1.2):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            nodes = order[a : a + BATCH]
            _, _, seen, _ = beam_search(points, graph, start, points[nodes], beam, visits=True)
            graph[nodes] = robust_prune(points, nodes, np.concatenate([seen, graph[nodes]], axis=1), alpha, degree)
            _add_back(points, graph, nodes, alpha)
    while not (seen := _reached(graph, start)).all():
        lost = np.flatnonzero(~seen)[:BATCH]
        near = beam_search(points, graph, start, points[lost], beam)[0][:, 0]
        for x, y in zip(lost.tolist(), near.tolist(), strict=True):  # the last slot: its nearest kept edges stay
            free = np.flatnonzero(graph[y] < 0)
            if len(free):
                graph[y, free[0]] = x
            else:  # hand the old neighbour on, so that it stays in reach
                graph[x, -1], graph[y, -1] = graph[y, -1], x
    return graph, start


def valid(vec: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _rows(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(vec_id, vec, dim), each different one once."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & valid(F.col("vec"))).distinct().withColumn("dim", F.size("vec"))


def scaled(vectors: np.ndarray, unit: float) -> np.ndarray:
    """Vectors in units of the shard's middle one, so that squares neither
    vanish nor overflow, however far away some vectors are."""
    return np.clip(vectors / unit, -1e150, 1e150)


def middle(vectors: np.ndarray) -> float:
    return float(np.median(np.abs(vectors).max(axis=1)))


def _build(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(group["vec"].to_numpy())
    ids = group["vec_id"].to_numpy()
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    nodes = vectors[new]
    first = np.append(np.flatnonzero(new), len(ids))
    graph, start = build_graph(scaled(nodes, middle(nodes)))
    return pd.DataFrame({
        "dim": [int(group["dim"].iloc[0])], "shard": [int(group["shard"].iloc[0])], "to": [int(group["to"].iloc[0])], "start": [start], "ids": [ids.astype(np.int64).tobytes()],
        "first": [first.astype(np.int64).tobytes()], "vectors": [nodes.tobytes()], "graph": [graph.tobytes()],
    })


INDEX = "dim int, shard int, to int, start int, ids binary, first binary, vectors binary, graph binary"


def build_index(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """One row for each shard: a table that searches read."""
    with_workers(df.sparkSession)
    rows = save(_rows(df, vec_id, vec))
    shards = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    # Shards are numbered through; one row for each length of vectors.
    before = F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    shards = save(shards.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")))
    n = shards.agg(F.sum("shards")).first()[0] or 1
    placed = rows.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards").cast("long")).cast("int"))
    placed = placed.select("dim", "shard", (F.col("before") + F.col("shard")).alias("to"), "vec_id", "vec")

    def run(frames):  # a task has one shard
        held = [f for f in frames if len(f)]
        if held:
            yield _build(pd.concat(held, ignore_index=True))

    return save(placed.repartitionById(n, "to").mapInPandas(run, INDEX))


class Shard:
    """A shard's graph, answering queries."""

    def __init__(self, row):
        self.ids, self.first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.first) - 1, -1)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.vectors), -1)
        self.start, self.unit = int(row["start"]), middle(self.vectors)
        self.points = scaled(self.vectors, self.unit)

    def _held(self, x: np.ndarray, me: int, found: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Of the nodes found, the k nearest other ids, each by its nearest vector."""
        with np.errstate(over="ignore"):
            score = np.sqrt(((self.vectors[found] - x) ** 2).sum(axis=1))
        best: dict[int, float] = {}
        for s, node in sorted(zip(score.tolist(), found.tolist(), strict=True)):
            # Of equal vectors, the smallest k ids and its own decide.
            for i in self.ids[self.first[node] : self.first[node + 1]][: k + 1].tolist():
                if i != me:
                    best.setdefault(i, s)
        return sorted((s, i) for i, s in best.items())[:k]

    def top(self, asked: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The k nearest (score, id) of each query.  Where the beam holds less
        than k other ids, it is widened, to the whole shard at last."""
        out: list[list[tuple[float, int]]] = [[] for _ in own]
        todo, beam = np.arange(len(own)), max(SEARCH_BEAM, 2 * k)
        while len(todo):
            nodes, _ = beam_search(self.points, self.graph, self.start, scaled(asked[todo], self.unit), min(beam, len(self.points)))
            for q, found in zip(todo.tolist(), nodes, strict=True):
                out[q] = self._held(asked[q], int(own[q]), found[found >= 0], k)
            todo = todo[[len(out[q]) < k for q in todo.tolist()]] if beam < len(self.points) else todo[:0]
            beam *= 4
        return out


def search(index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every query, but
    not rows of its own id."""
    asked = save(_rows(queries, vec_id, vec))
    blocks = max(1, -(-asked.count() // QUERIES))
    shards = index.select("dim", "to")
    n = ((index.agg(F.max("to")).first()[0] or 0) + 1) * blocks
    # Every block of queries is sent to every shard of its length: a stated query set against all rows.
    at = lambda block: (F.col("to") * blocks + block).alias("at")
    sent = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(shards, "dim").select(at(F.col("block")), F.lit(1).alias("kind"), "vec_id", "vec")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(at(F.col("block")), F.lit(0).alias("kind"), "start", "ids", "first", "vectors", "graph")

    def run(frames):  # a task has one shard and then a block of queries
        shard = None
        for frame in frames:
            if len(frame) and frame["kind"].iloc[0] == 0:
                shard, frame = Shard(frame.iloc[0]), frame.iloc[1:]
            for a in range(0, len(frame), BATCH):
                part = frame.iloc[a : a + BATCH]
                own = part["vec_id"].to_numpy().astype(np.int64)
                found = shard.top(np.stack(part["vec"].to_numpy()), own, k)
                rows = [(me, i, s) for me, got in zip(own.tolist(), found, strict=True) for s, i in got]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    rows = held.unionByName(sent, allowMissingColumns=True).repartitionById(n, F.col("at")).sortWithinPartitions("at", "kind")
    found = rows.mapInPandas(run, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """The 10 nearest of each row whose vec_id is divisible by 100."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(rows), rows.where("vec_id % 100 = 0"))
