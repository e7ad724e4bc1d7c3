import random

import numpy as np
import pytest
from conftest import SF_SMALL  # noqa: F401

from logweave.operators import components as op
from logweave.operators.joins import join_hot


def roots(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_spanning_stars_keep_components():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(2, 60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 80))]
        a, b = op.spanning_stars(*(np.array(x) for x in zip(*edges, strict=True)))
        want = roots(n, edges)
        assert roots(n, list(zip(a.tolist(), b.tolist(), strict=True))) == want
        assert [want[x] for x in b] == a.tolist() and len(set(b.tolist())) == len(b)


def test_a_long_path_shrinks_in_one_task():
    n = 200_000
    order = np.random.default_rng(1).permutation(n)
    a, b = op.spanning_stars(order[:-1], order[1:])
    assert (a == 0).all() and len(b) == n - 1


@pytest.mark.parametrize("chunk", [10, 1_000_000])
def test_components_of_strings_and_numbers(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "LAST", chunk)
    rng = random.Random(8)
    n = 400
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(330)] + [(i, i + 1) for i in range(100, 180)]
    want = roots(n, edges)
    v = spark.range(n)
    e = spark.createDataFrame(edges, "i bigint, j bigint").repartition(7)
    assert {r.id: r.component for r in op.connected_components(v, e).collect()} == dict(enumerate(want))
    name = lambda x: f"v{x:05d}"
    ve, ee = (spark.createDataFrame([tuple(map(name, r)) for r in rows], s) for rows, s in (([(x,) for x in range(n)], "id string"), (edges, "i string, j string")))
    assert {r.id: r.component for r in op.connected_components(ve, ee.repartition(5)).collect()} == {name(x): name(r) for x, r in enumerate(want)}


def test_the_edges_of_a_hub_stay_where_they_are(spark, monkeypatch):
    """A star of 100,000 leaves around the largest vertex, over many tasks: in
    the joined rows of a round no task has more than three times the median."""
    n = 100_000
    monkeypatch.setattr(op, "LAST", 5000)  # so that there are rounds
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        e = spark.range(0, n, 1, 16).selectExpr("id AS a", f"{n}L AS b")
        neighbours = op._neighbours(e)
        m = neighbours.groupBy("u").agg({"v": "min", "*": "count"}).toDF("u", "deg", "m")
        joined = join_hot(neighbours, m.select("u", "m", "deg"), ["u"], m["deg"], 2 * n, "inner")
        sizes = sorted(r["count"] for r in joined.groupBy(__import__("pyspark").sql.functions.spark_partition_id()).count().collect())
        assert sum(sizes) == 2 * n and sizes[-1] <= 3 * sizes[len(sizes) // 2]
        got = op.connected_components(spark.range(n + 1), e, src="a", dst="b")
        assert got.where("component <> 0").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_join_hot_is_a_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, None if i % 11 == 0 else "x", i) for i in range(300)], "k int, t string, v int")
    table = spark.createDataFrame([(k, "x", 300 if k == 0 else 1, k * 10) for k in range(5)], "k int, t string, n int, out int")
    for how in ("left", "inner"):
        for total in (300, 10**9):
            got = join_hot(rows, table, ["k", "t"], table["n"], total, how, most=10).select("k", "t", "v", "n", "out")
            want = rows.join(table, ["k", "t"], how).select("k", "t", "v", "n", "out")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
