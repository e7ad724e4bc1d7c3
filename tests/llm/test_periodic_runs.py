import random
import zlib
from hashlib import sha256

import numpy as np

from logweave.llm import periodic_runs as op

from .conftest import documents


def all_runs(w, least=12):
    """Every run by its definition: maximal stretches for every period."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            s = t
            while t + q < n and w[t] == w[t + q]:
                t += 1
            length = t - s + q
            if t > s and length >= max(least, 2 * q):
                x = w[s : s + length]
                if not any(x[:-p] == x[p:] for p in range(1, q)):
                    out.add((s, length, q))
            t += t == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_fibonacci_and_planted_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 80), rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(n)]
        kind = rng.random()
        if kind < 0.4 and n:
            p, s = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            for i in range(s + p, n):
                w[i] = w[i - p]
        elif kind < 0.6:
            x, y = [0], [0, 1]
            while len(y) < n:
                x, y = y, y + x
            w = y[:n]
        least = rng.choice([2, 5, 12])
        assert [tuple(r) for r in op.find_runs(np.array(w, dtype=np.int64), least).tolist()] == all_runs(w, least)


def test_long_runs_take_no_quadratic_time():
    ones = op.find_runs(np.zeros(200_000, np.int64))
    assert ones.tolist() == [[0, 200_000, 1]]
    comb = op.find_runs(np.array(([0] * 1000 + [1]) * 100))
    assert len(comb) == 101 and [0, 100_100, 1001] in comb.tolist()


def expected(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    hexed = lambda x: sha256(x).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hexed("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), hexed(b" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_digest_of_odd_and_planted_documents(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b c", "ä"]) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(120)]
    docs = odd_docs.where("length(text) < 10000 OR text IS NULL").unionByName(documents(spark, rows))
    want = sorted((expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    got = sorted((tuple(r) for r in op.digest(docs, rewrite=op.plant).collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 5
    assert op.digest(no_docs).count() == 0


def test_very_long_text(spark, odd_docs):
    got = op.with_runs(odd_docs.where("doc_id in (4, 5, 9)")).collect()
    assert all(r["runs"] == [] for r in got)


def test_runs_and_collapse_keep_other_columns(spark, odd_docs):
    docs = spark.createDataFrame([(1, "x a b a b a b a b a b a b y", 7, "was"), (2, None, 8, "was"), (3, "", 9, "was")], "doc_id int, text string, runs int, collapsed string")
    got = op.collapse(op.with_runs(docs)).orderBy("doc_id").collect()
    assert [r["collapsed"] for r in got] == ["x a b y", None, ""]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(1, 12, 2)], [], []]
    assert op.collapse(docs, collapsed="text").orderBy("doc_id").collect()[0]["text"] == "x a b y"
