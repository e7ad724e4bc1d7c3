import math
import random
from collections import Counter, defaultdict

import numpy as np

from logweave.llm import bm25_search, common, graph_search
from logweave.llm.common import WORD

from .conftest import documents, prose


def nearest(rows, k=10):
    out = {}
    for q, x in rows:
        if q % 100 == 0:
            best = sorted({(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q})
            out[q] = best[:k]
    return out


def searched(spark, rows, shard_rows=300):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in graph_search.search(graph_search.build_index(df, shard_rows=shard_rows), df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_over_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.5 * rng.normal(size=32)).astype(np.float32)]) for i in range(2000)]
    want, got = nearest(rows), searched(spark, rows)
    assert set(want) == set(got)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        for score, i in found:
            assert math.isclose(score, np.linalg.norm(np.array(vectors[i]) - np.array(vectors[q])), rel_tol=1e-12)


def test_ties_and_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.5]) for i in range(700)]
    got, want = searched(spark, rows, 200), nearest(rows)
    for q in want:
        if rows[q][1] == [1.0, 2.0, 3.0]:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]


def test_one_id_with_many_vectors_near_the_query(spark):
    rng = np.random.default_rng(2)
    rows = [(100, [1.0, 1.0, 1.0])] + [(7, [1.0 + 0.001 * k, 1.0, 1.0]) for k in range(199)]
    rows += [(i, [float(x) for x in 5 + rng.normal(size=3)]) for i in range(201, 221)]
    got = searched(spark, rows)[100]
    assert len(got) == 10 and got[0][1] == 7 and len({i for _, i in got}) == 10
    own = [(100, [1.0 + 0.001 * k, 2.0, 1.0]) for k in range(300)] + rows[200:]
    assert len(searched(spark, own)[100]) == 10


def test_a_vector_far_out(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(600)]
    rows[5] = (5, [1e24] + [1.0] * 15)
    want, got = nearest(rows), searched(spark, rows)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, [float(i), 1.0], 1, 2, "x", 3, 4) for i in range(250)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, shard int, dim int, vec string, kind int, at int")
    got = graph_search.search(graph_search.build_index(df, shard_rows=100), df.where("vec_id % 100 = 0")).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [99, 101, 98, 102, 97, 103, 96, 104, 95, 105]


def test_vectors_that_take_no_part(spark):
    bad = [(200, None), (300, []), (400, [0.0, 0.0]), (500, [1.0, None]), (600, [float("nan"), 1.0]), (700, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (100, [5.0, 5.0, 5.0])]
    got = searched(spark, bad + good)
    assert got == {0: [(1.0, 2), (math.sqrt(2), 1)]}
    assert searched(spark, bad) == {}


def test_every_node_can_be_reached():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(300, 8)), 100 + rng.normal(size=(300, 8)), 1e4 + rng.normal(size=(40, 8))]).astype(np.float32)
    graph, start = graph_search.build_graph(points)
    assert graph_search._reached(graph, start).all()
    assert (graph < len(points)).all() and (graph != np.arange(len(points))[:, None]).all()


def bm25(rows, k=10):
    docs = [(i, Counter(WORD.findall(t.lower()))) for i, t in rows if i is not None and t is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    terms = defaultdict(set)
    for i, c in docs:
        if i % 100 == 0:
            terms[i] |= set(c)
    out = {}
    for q, words in terms.items():
        best = []
        for i, c in docs:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in words if c[w])
            if s > 0:
                best.append((-round(s, 6), i))
        if best:
            out[q] = sorted(best)[:k]
    return out


def found(df):
    got = defaultdict(list)
    for r in bm25_search.search(bm25_search.build_index(df), df.where("doc_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], -round(r["score"], 6), r["doc_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_bm25_equals_scoring_everything(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, prose(rng, words, rng.randint(1, 200)), "en", "a") for i in range(700)]
    rows += [(1000 + i, rows[i % 40][1], "en", "a") for i in range(200)]
    df = documents(spark, rows).repartition(5)
    want = bm25([r[:2] for r in rows])
    assert found(df) == want
    monkeypatch.setattr(bm25_search, "POSTINGS", 3000)  # many shards, and remainders that are merged
    assert found(df) == want


def test_bm25_moves_neither_index_nor_queries(spark, monkeypatch):
    """Many shards, bundles and groups: the best are the only rows that are
    shuffled, queries are written once, and parts go when they are merged."""
    rng = random.Random(4)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    rows = [(i, prose(rng, words, rng.randint(1, 120)), "en", "a") for i in range(0, 3000, 5)]
    df = documents(spark, rows).repartition(6)
    for name, value in (("POSTINGS", 1000), ("BUNDLE", 200), ("GROUP", 500)):
        monkeypatch.setattr(bm25_search, name, value)
    written = len(common._written)
    index = bm25_search.build_index(df)
    assert len(common._written) == written + 1
    shards = index.select("shard", "n_postings").collect()
    assert len(shards) > 6 and max(r.n_postings for r in shards) <= 1000
    asked = df.where("doc_id % 100 = 0")
    got = bm25_search.search(index, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "CartesianProduct" in plan
    bundles, groups = bm25_search._bundled(bm25_search._weighted(asked, index, len(rows), "doc_id", "text"))
    assert groups > 1 and sum(len(r.query_ids) // 8 for r in bundles.collect()) == 30
    assert bundles.count() > groups
    assert found(df) == bm25([r[:2] for r in rows])


def shard_of(n, rng):
    docs, terms = [], []
    for t, every in enumerate((1, 2, 3, 50, 400)):
        docs.append(np.flatnonzero(rng.random(n) < 1 / every))
        terms.append(np.full(len(docs[-1]), t))
    docs, terms = np.concatenate(docs), np.concatenate(terms)
    order = np.argsort(docs, kind="stable")
    made = bm25_search.Shard(np.arange(n), rng.integers(5, 500, n), terms[order], docs[order], rng.integers(1, 9, len(docs)))
    parts = [dict(zip(bm25_search.PART_NAMES, made.row(), strict=True))]
    shard = bm25_search.Shard.merged(parts)
    shard.weigh(100.0)
    return shard


def test_a_shard_passes_over_blocks(monkeypatch):
    """Blocks whose maxima don't reach the k-th score are not scored, and
    nothing is lost by that or by a floor from elsewhere."""
    shard = shard_of(64_000, np.random.default_rng(7))
    assert (np.diff(shard.lengths) <= 0).all()
    queries = [(np.array([0, 1, 4, 77]), np.array([0.01, 0.2, 6.0, 1.0])), (np.array([0, 2, 3]), np.array([0.1, 0.1, 3.0])), (np.array([99]), np.array([1.0]))]
    want = []
    for terms, idf in queries:
        score = np.zeros(len(shard.ids))
        for t, w in zip(terms, idf, strict=True):
            if t in shard.terms:
                a, b = shard.first[np.searchsorted(shard.terms, t) :][:2]
                score[shard.docs[a:b]] += w * shard.impacts[a:b]
        best = sorted((-round(s, 9), i) for s, i in zip(score.tolist(), shard.ids.tolist(), strict=True) if s > 0)[:10]
        want.append([(i, -s) for s, i in best])
    looked = []
    nonzero = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: looked.append(x.size) or nonzero(x))
    got = shard.top(queries, 10)
    assert [[(i, round(s, 6)) for i, s in g] for g in got] == [[(i, round(s, 6)) for i, s in w] for w in want] and got[2] == []
    assert sum(looked) < len(queries) * len(shard.ids) / 2
    floor = np.array([want[0][4][1], want[1][4][1] + 1, 0.0])
    some = shard.top(queries, 10, floor)
    assert [i for i, _ in some[0]][:5] == [i for i, _ in got[0]][:5]
    assert all(s >= floor[1] - 1e-6 for _, s in some[1])


def test_bm25_on_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs) == bm25([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found(no_docs) == {}
