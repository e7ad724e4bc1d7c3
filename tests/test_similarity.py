import math

import numpy as np

from conftest import SF_SMALL

from logweave.operators.similarity import approx_recall, band_keys, bands_for, count_similar_pairs, similar_between, similar_pairs, similar_pairs_approx


def _brute(vecs, ids, t):
    out = set()
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = vecs[a], vecs[b]
            d = np.cumsum((x * y).astype(np.float64))[-1]
            den = np.sqrt(np.cumsum((x * x).astype(np.float64))[-1]) * np.sqrt(np.cumsum((y * y).astype(np.float64))[-1])
            c = 0.0 if den == 0 else d / den
            if c >= t:
                out.add((min(ids[a], ids[b]), max(ids[a], ids[b]), round(c, 9)))
    return out


def test_blocked_join_equals_all_pairs(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = e.collect()
    vecs = [np.array(r.embedding, dtype=np.float32) for r in rows]
    ids = [r.vec_id for r in rows]
    want = _brute(vecs, ids, 0.3)
    for bs in (16, 64, 10_000):
        got = {(r.i, r.j, round(r.cosine, 9)) for r in similar_pairs(e, "vec_id", "embedding", 0.3, block_size=bs).collect()}
        assert got == want
    assert len(want) > 10


def test_approx_has_no_false_pairs(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    exact = {(r.i, r.j) for r in similar_pairs(e, "vec_id", "embedding", 0.3).collect()}
    approx = {(r.i, r.j) for r in similar_pairs_approx(e, "vec_id", "embedding", 0.3, recall=0.95, bits=4).collect()}
    assert approx <= exact
    assert len(approx) >= 0.9 * len(exact)


def test_approx_recall_on_many_vectors(spark):
    """12,000 vectors, most pairs near the threshold: the designed recall is
    reached, the measured one says so, and far from all pairs are compared."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 48))
    vecs = (base[rng.integers(0, 1500, 12_000)] + 0.38 * rng.normal(size=(12_000, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<float>").repartition(4).cache()
    exact = {(r.i, r.j) for r in similar_pairs(df, "id", "v", 0.85).select("i", "j").collect()}
    found = similar_pairs_approx(df, "id", "v", 0.85, recall=0.95).select("i", "j").cache()
    got = {(r.i, r.j) for r in found.collect()}
    assert len(exact) > 20_000 and got <= exact and len(got) >= 0.93 * len(exact)
    row = approx_recall(df, found, "id", "v", 0.85, sample=150).first()
    assert row.sampled == 150 and row.exact_pairs > 300 and 0.9 <= row.recall <= 1
    keys = band_keys(vecs[:3000], bands_for(0.85, 0.95, 12), 12, 7)
    share = np.mean([(keys[i] == keys[j]).any() for i, j in rng.integers(0, 3000, (4000, 2)) if i != j])
    assert share < 0.1


def test_bands_follow_threshold_and_recall():
    for t, recall, bits in ((0.85, 0.95, 12), (0.5, 0.9, 4), (0.99, 0.999, 20)):
        one = (1 - math.acos(t) / math.pi) ** bits
        b = bands_for(t, recall, bits)
        assert 1 - (1 - one) ** b >= recall > 1 - (1 - one) ** (b - 1)


def test_counts_without_pairs(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = similar_pairs(e, "vec_id", "embedding", 0.2).count()
    for size in (16, 10_000):
        assert count_similar_pairs(e, "vec_id", "embedding", 0.2, block_size=size).first()["n"] == want
    assert count_similar_pairs(e.limit(0), "vec_id", "embedding", 0.2).first()["n"] == 0


def test_pairs_between_two_tables(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    n = e.count()
    a, b = e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0")
    want = {(r.i, r.j, round(r.cosine, 9)) for r in similar_pairs(e, "vec_id", "embedding", 0.2).where("i % 3 = 0 <> (j % 3 = 0)").collect()}
    for size in (7, n):
        assert {(r.i, r.j, round(r.cosine, 9)) for r in similar_between(a, b, "vec_id", "embedding", 0.2, block_size=size).collect()} == want
    assert len(want) > 10 and similar_between(a.limit(0), b, "vec_id", "embedding", 0.2).count() == 0


def test_blocks_meet_without_a_nested_loop(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    plan = similar_pairs(e, "vec_id", "embedding", 0.3, block_size=16)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_block_kernel_chunks(monkeypatch):
    import pandas as pd

    from logweave.operators import similarity as S

    rng = np.random.default_rng(1)
    base = rng.normal(size=(5, 16)).astype(np.float32)
    vecs = np.concatenate([base[rng.integers(0, 5, 300)] + 0.05 * rng.normal(size=(300, 16)).astype(np.float32)])
    ids = np.arange(300, dtype=np.int64) * 7 + 3
    pdf = pd.DataFrame({"_id": ids, "_v": list(vecs.astype(np.float32)), "_side": 0})
    want = {(a, b, round(c, 9)) for a, b, c in _brute(list(vecs.astype(np.float32)), list(ids), 0.9)}
    for cells, pairs in ((2100, 7), (300 * 64, 100), (1 << 20, 1 << 14)):
        monkeypatch.setattr(S, "CHUNK_CELLS", cells)
        monkeypatch.setattr(S, "CHUNK_PAIRS", pairs)
        got = S._block_pairs(0.9)(pdf)
        assert {(int(r.i), int(r.j), round(r.cosine, 9)) for r in got.itertuples()} == want
    assert len(want) > 100


def _parts(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(x) for x in range(n)]


def _same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_forest_has_the_same_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = (base[rng.integers(0, 40, 500)] + 0.25 * rng.normal(size=(500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<float>")
    all_pairs = [(r.i, r.j) for r in similar_pairs(df, "id", "v", 0.9).collect()]
    for size in (50, 10_000):
        forest = [(r.i, r.j) for r in similar_pairs(df, "id", "v", 0.9, block_size=size, forest=True).collect()]
        assert set(forest) <= set(all_pairs) and len(forest) < len(all_pairs) / 2
        assert _same(_parts(500, forest), _parts(500, all_pairs))


def test_far_blocks_are_not_paired(spark):
    """Vectors in two distant directions: blocks of one never meet those of the other."""
    from logweave.operators.similarity import _by_angle

    rng = np.random.default_rng(3)
    vecs = np.concatenate([[1, 0, 0, 0] + 0.05 * rng.normal(size=(100, 4)), [0, 1, 0, 0] + 0.05 * rng.normal(size=(100, 4))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "_id long, _v array<float>")
    spans = {(r["_b"], r["_from"], r["_to"]) for r in _by_angle(df, 0.85, 20).collect()}
    assert spans == {(b, 0, 4) for b in range(5)} | {(b, 5, 9) for b in range(5, 10)}
    want = _brute([np.array(r["_v"], np.float32) for r in df.collect()], list(range(200)), 0.85)
    got = {(r.i, r.j, round(r.cosine, 9)) for r in similar_pairs(df, "_id", "_v", 0.85, block_size=20).collect()}
    assert got == want


def test_block_of_near_equal_vectors_stays_small():
    """4,096 vectors that are all alike: memory of a block is bounded."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pandas as pd
from logweave.operators.similarity import _block_pairs
rng = np.random.default_rng(1)
v = (rng.random(128) + 0.01 * rng.random((4096, 128))).astype(np.float32)
pdf = pd.DataFrame({"_id": np.arange(4096), "_v": list(v), "_side": 0})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = _block_pairs(0.85, forest=True)(pdf)
assert len(out) == 4095 and len(set(out["i"]) | set(out["j"])) == 4096
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 700


def test_pairs_near_the_pivot_meet(spark):
    """The angle of a vector almost equal to the pivot is coarse; a pair at
    the threshold still meets when every block is one vector."""
    t = 0.9
    missed = []
    for k, near in enumerate((1e-4, 2e-4, 3e-4, 1e-3)):
        angles = [0.3, 0.3 + near, 0.3 + near + math.acos(t) - 2e-7]
        df = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "id bigint, v array<float>")
        exact = _brute([np.array(r["v"], np.float32) for r in df.orderBy("id").collect()], [0, 1, 2], t)
        got = {(r[0], r[1]) for r in similar_pairs(df, "id", "v", t, block_size=1).collect()}
        missed += [(k, p) for p in {(x[0], x[1]) for x in exact} - got]
    assert not missed


def test_a_vector_is_sent_a_bounded_number_of_times(spark):
    """Blocks grow with the input: the smallest ones asked for don't multiply the rows."""
    from logweave.operators.similarity import MEETS, _block_groups

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert _block_groups(e, "vec_id", "embedding", 0.3, 4, None).count() <= MEETS * e.count()


def test_approx_quality_without_moving_pairs(spark):
    """Pairs come once although they share several bands, no exchange has
    them, and the counts are those of the joined pairs."""
    from logweave.operators.similarity import approx_quality

    rng = np.random.default_rng(5)
    vecs = (rng.normal(size=(30, 16))[rng.integers(0, 30, 600)] + 0.3 * rng.normal(size=(600, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<float>").cache()
    found = similar_pairs_approx(df, "id", "v", 0.7, recall=0.9, bits=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partitioning(i#" not in plan and "keys=[i#" not in plan
    exact = {(r.i, r.j) for r in similar_pairs(df, "id", "v", 0.7).collect()}
    got = [(r.i, r.j) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) <= exact and 0.9 * len(exact) <= len(got)
    assert tuple(approx_quality(df, found, "id", "v", 0.7, 64).first()) == (len(exact), 0, len(got))
    wrong = spark.createDataFrame([(1, 2, 0.1), (4, 3, 0.9), (5, 6, None), (7, 8, 0.9)], "i long, j long, cosine double")
    assert tuple(approx_quality(df, wrong, "id", "v", 0.7).first()) == (len(exact), 3, 1)


def test_approx_pairs_are_counted_in_their_groups(spark):
    """The number is that of the pairs, with ids that come twice, buckets of
    several blocks and several buckets in a group; only numbers leave a group."""
    from logweave.operators import similarity
    from logweave.operators.similarity import approx_quality

    rng = np.random.default_rng(6)
    vecs = (rng.normal(size=(20, 16))[rng.integers(0, 20, 250)] + 0.5 * rng.normal(size=(250, 16))).astype(np.float32)
    vecs[7], vecs[8] = 0, vecs[9] * np.float32(1e30)
    df = spark.createDataFrame([(i if i % 50 else i // 2, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<float>").cache()
    for bits, most in ((2, 64), (4, 1 << 15)):
        similarity.MOST, kept = most, similarity.MOST
        try:
            pairs = similar_pairs_approx(df, "id", "v", 0.6, recall=0.9, bits=bits, block_size=64)
            n = similar_pairs_approx(df, "id", "v", 0.6, recall=0.9, bits=bits, block_size=64, count=True)
            assert [tuple(r) for r in n.collect()] == [(pairs.count(),)]
        finally:
            similarity.MOST = kept
    exact = count_similar_pairs(df, "id", "v", 0.6, 64).first()["n"]
    assert exact == similar_pairs(df, "id", "v", 0.6, 64).count() >= n.first()["n"] > 0
    assert tuple(approx_quality(df, n, "id", "v", 0.6, 64).first()) == (exact, 0, n.first()["n"])
    assert "cosine" not in n._jdf.queryExecution().executedPlan().toString()
    none = similar_pairs_approx(df.limit(0), "id", "v", 0.6, count=True)
    assert tuple(none.first()) == (0,)


def test_tiles_count_what_the_exact_arithmetic_pairs(monkeypatch):
    """Pairs at the threshold, odd lengths, equal ids, negative thresholds:
    as many as the exact arithmetic has, tile by tile."""
    from logweave.operators import similarity

    rng = np.random.default_rng(11)
    v = rng.integers(-2, 3, (180, 6)).astype(np.float32)
    v[:4] = [[1e30] * 6, [1e-30] * 6, [np.nan] * 6, [0] * 6]
    ids = rng.integers(0, 120, 180)
    monkeypatch.setattr(similarity, "TILE", (16, 32))
    monkeypatch.setattr(similarity, "CHUNK_PAIRS", 5)
    keys = rng.integers(0, 4, (180, 3)).astype(np.uint8)
    apart, upper = ~(keys[:, None] == keys[None]).any(axis=2), ids[:, None] < ids[None]
    with np.errstate(all="ignore"):
        for threshold in (0.5, 0.25, 1.0, 0.0, -0.2):
            if threshold <= 0:
                v[:4] = 1
            near = np.stack([similarity._java_cos_rows(np.broadcast_to(x, v.shape), v) for x in v]) >= threshold
            assert similarity._count(v, v, ids, ids, True, threshold) == np.count_nonzero(near & upper)
            assert similarity._count(v, v, ids, ids, True, threshold, (keys, keys)) == np.count_nonzero(near & upper & apart)
            assert similarity._count(v[:70], v[70:], ids[:70], ids[70:], False, threshold) == np.count_nonzero(near[:70, 70:])
            assert similarity._count(v[:70], v[70:], ids[:70], ids[70:], False, threshold, (keys[:70], keys[70:])) == np.count_nonzero((near & apart)[:70, 70:])


def test_counts_of_odd_lengths(spark):
    """Lengths beyond those of float products are counted as they are paired."""
    big = [[1e30, 1e30], [1e30, 2e30], [1e-30, 1e-30], [2e-30, 1e-30], [1.0, 1.0], [0.0, 0.0], [1.0, 1.1]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(big)], "id long, v array<float>")
    assert count_similar_pairs(df, "id", "v", 0.5).first()["n"] == similar_pairs(df, "id", "v", 0.5).count() == 1


def test_quality_of_templates_and_vectors(spark):
    from logweave.plans.queries import QUERIES

    assert sorted(r.vectors for r in QUERIES["approx_pairs_quality"](spark, SF_SMALL).collect()) == ["embeddings", "templates"]
