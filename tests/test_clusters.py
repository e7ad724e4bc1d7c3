import os
import random
import re

import numpy as np

from conftest import lines_df

from logweave.functions import fixed
from logweave.operators.components import connected_components, global_row_number
from logweave.operators.features import template_vector
from logweave.operators.ingest import ingest
from logweave.plans.analyze import cluster_entries, heuristic_results
from logweave.sources.logs import read_log_lines

HERE = os.path.dirname(os.path.abspath(__file__))


def _template(s):
    if s is None:
        return ""
    s = s.lower()
    s = re.sub(r"0x[0-9a-f]+", "<HEX>", s)
    s = re.sub(r"[0-9]+", "<NUM>", s)
    return re.sub(r"[^a-z<>]+", " ", s).strip()


def _cos(a, b):
    d = np.cumsum((a * b).astype(np.float64))[-1]
    den = np.sqrt(np.cumsum((a * a).astype(np.float64))[-1]) * np.sqrt(np.cumsum((b * b).astype(np.float64))[-1])
    return 0.0 if den == 0 else d / den


def brute_partition(messages):
    """All-pairs single linkage over entries (the O(n^2) definition)."""
    vecs = [template_vector(_template(m)) for m in messages]
    n = len(vecs)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if _cos(vecs[i], vecs[j]) >= fixed.SIMILARITY_THRESHOLD:
                parent[find(j)] = find(i)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return sorted(sorted(g) for g in groups.values())


def spark_partition(spark, lines):
    c = cluster_entries(ingest(lines_df(spark, lines)))
    rows = c.members.select("cluster_no", "line_no").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster_no, []).append(r.line_no - 1)
    return sorted(sorted(g) for g in groups.values()), c


def test_sample_file_matches_all_pairs_definition(spark):
    path = os.path.join(HERE, "data", "sample.log")
    raw = [r.raw_line for r in read_log_lines(spark, path).orderBy("line_no").collect()]
    assert len(raw) == 13
    msgs = [r.message for r in ingest(lines_df(spark, raw)).orderBy("line_no").collect()]
    assert len(msgs) == 13
    got, c = spark_partition(spark, raw)
    assert got == brute_partition(msgs)
    # ferries, a chain of three readings (the first and the last only meet through the second), evicted tiles
    assert [g for g in got if len(g) > 1] == [[0, 3, 11], [1, 4, 7], [5, 8]]
    ends = [template_vector(_template(msgs[k])) for k in (1, 7)]
    assert _cos(*ends) < fixed.SIMILARITY_THRESHOLD
    # cluster numbers follow the first member; results carry Cluster-N:id
    res = heuristic_results(c.clusters).orderBy("cluster_no").collect()
    assert res[0].log_entry_id.startswith("Cluster-1:") and len(res) == len(got)


def test_few_lines(spark):
    some = [
        "2031-11-20 17:09:00 INFO  Quay - Crane 2 wants a new connection to the yard",
        "2031-11-20 17:09:30 DEBUG Tower - Ice report: nothing new",
        "2031-11-20 17:10:00 WARN  Quay - Crane 5 wants a new connection to the yard",
        "2031-11-20 17:10:01 WARN  Planner - Berth planner at 61 percent of its heap",
    ]
    assert spark_partition(spark, some)[0] == [[0, 2], [1], [3]]


def test_zero_vectors_stay_single(spark):
    lines = ['{"level":"ERROR"}', '{"level":"ERROR"}', "2024-01-15 10:23:45 ERROR a - !!!", "2024-01-15 10:23:45 ERROR a - x y"]
    got, c = spark_partition(spark, lines)
    assert got == [[0], [1], [2], [3]]


def test_partition_invariant_to_row_order(spark):
    path = os.path.join(HERE, "data", "sample.log")
    raw = [r.raw_line for r in read_log_lines(spark, path).orderBy("line_no").collect()]
    a, _ = spark_partition(spark, raw)
    df = lines_df(spark, raw).repartition(7)
    c = cluster_entries(ingest(df))
    groups = {}
    for r in c.members.collect():
        groups.setdefault(r.cluster_no, []).append(r.line_no - 1)
    assert sorted(sorted(g) for g in groups.values()) == a


def _bfs_components(n, edges):
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    comp = {}
    for s in range(n):
        if s in comp:
            continue
        stack, seen = [s], {s}
        while stack:
            u = stack.pop()
            for v in adj[u]:
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        m = min(seen)
        for v in seen:
            comp[v] = m
    return comp


def test_components_random_graphs(spark):
    rnd = random.Random(3)
    for n, m in [(1, 0), (30, 0), (50, 40), (200, 150), (300, 600)]:
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        chain = [(i, i + 1) for i in range(0, min(n - 1, 40))]  # a long path
        edges += chain
        v = spark.createDataFrame([(i,) for i in range(n)], "id long")
        e = spark.createDataFrame(edges or [(0, 0)], "i long, j long")
        got = {r.id: r.component for r in connected_components(v, e).collect()}
        assert got == _bfs_components(n, [x for x in edges if x[0] != x[1]])


def test_global_row_number(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.randrange(10_000)) for _ in range(500)]
    rows = list({r: None for r in rows})
    df = spark.createDataFrame(rows, "s string, n long").repartition(5)
    want = [(i + 1, s, n) for i, (s, n) in enumerate(sorted(rows))]
    for parts in (6, None):  # explicit ranges, and AQE-coalesced ranges
        got = sorted((r.row_no, r.s, r.n) for r in global_row_number(df, ["s", "n"], partitions=parts).collect())
        assert got == want


def test_release_keeps_results_readable(spark):
    c = cluster_entries(ingest(lines_df(spark, ["2024-01-15 10:23:45 ERROR a - x 1", "2024-01-15 10:23:46 ERROR a - x 2"])))
    assert c.members.count() == 2 and all(os.path.isdir(w.path.removeprefix("file:")) for w in c.written)
    n = c.clusters.count()
    c.release()
    assert c.clusters.count() == n == 1 and not any(os.path.exists(w.path.removeprefix("file:")) for w in c.written)


def test_analyze_keeps_nothing_cached(spark):
    from logweave.plans.analyze import analyze

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    lines = lines_df(spark, ["2024-01-15 10:23:45 ERROR a - x 1", "garbage", "2024-01-15 10:23:46 ERROR b - something else entirely"])
    for _ in range(2):
        assert analyze(lines).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_seams_of_the_clustering(spark):
    """Own vectors and an own similarity replace the built-in ones."""
    from pyspark.sql import functions as F

    from logweave.operators.similarity import similar_pairs_approx
    from logweave.plans.analyze import analyze

    lines = lines_df(spark, [f"2024-01-15 10:23:45 ERROR a - {m}" for m in ("abc abc abc", "zzz", "abc abc abd", "qqqq q")])
    assert [r.size for r in analyze(lines).orderBy("cluster_no").collect()] == [2, 1, 1]
    one = analyze(lines, embed=lambda t: F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))
    assert [r.size for r in one.collect()] == [4]
    none = analyze(lines, similar=lambda v: v.sparkSession.createDataFrame([], "i long, j long"))
    assert [r.size for r in none.collect()] == [1, 1, 1, 1]
    lsh = analyze(lines, similar=lambda v: similar_pairs_approx(v, "vkey", "vector", 0.85, recall=0.999, forest=True))
    assert sum(r.size for r in lsh.collect()) == 4


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    big = [f"line {i:05d} " + "x" * (i % 37) for i in range(1800)]
    files = {"big.log": big, "s1.log": ["a", "", "c"], "s2.log": [f"t{i}" for i in range(30)], "empty.log": []}
    for name, rows in files.items():
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("1024", "4096", "8192", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append({(os.path.basename(r.source), r.line_no, r.raw_line) for r in read_log_lines(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(name, i + 1, r) for name, rows in files.items() for i, r in enumerate(rows)}
    assert all(got == want for got in seen)
