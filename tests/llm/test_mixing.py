import re
from collections import Counter

import pytest

from logweave.llm import mixing as op

from .conftest import documents


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is left."""
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while rest > 1e-9:
        free = [k for k in names if target[k] < cap * sizes[k] - 1e-9]
        if not free:
            break
        total = sum(weight[k] for k in free)
        more = {k: min(rest * weight[k] / total, cap * sizes[k] - target[k]) for k in free}
        for k in free:
            target[k] += more[k]
        rest -= sum(more.values())
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def check(docs):
    rows = docs.collect()
    got = op.mix(docs).collect()
    assert Counter((r["doc_id"], words(r["text"])) for r in rows) == Counter((r["doc_id"], r["size"]) for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    target = filled(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        name = None if r["key"] == "n" else r["key"][1:]
        assert r["source_size"] == sizes[name]
        assert r["target"] == pytest.approx(target[name])
        assert 0 <= r["copies"] <= 2
        taken[name] += r["copies"] * r["size"]
        largest[name] = max(largest[name], r["size"])
    for name in sizes:
        assert abs(taken[name] - target[name]) <= largest[name] + 1
    return got


def test_targets_and_words_taken(sf):
    got = check(sf)
    again = op.mix(sf.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.where("doc_id IS NULL OR doc_id <> 8"))
    assert op.mix(no_docs).count() == 0
    out = op.mixed_rows(odd_docs)
    assert out.columns == odd_docs.columns
    times = Counter(map(str, out.collect()))
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in op.mix(odd_docs).collect()}
    for r in odd_docs.where("doc_id >= 100").collect():
        assert times[str(r)] == copies[r["doc_id"], words(r["text"])]
    assert op.mixed_rows(no_docs).count() == 0


def test_no_words_at_all(spark):
    got = op.mix(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r["target"], r["size"]) for r in got] == [(0.0, 0)] * 2


def test_order_is_by_random_odds_over_inclusion_odds(spark):
    """The documents taken are the head of the Pareto order."""
    rows = op.measured(documents(spark, [(i, "w " * (1 + i % 300), "en", "a") for i in range(900)]), "doc_id", "text", "source", 11)
    size = rows.agg({"size": "sum"}).first()[0]
    tgt = spark.createDataFrame([("sa", size, 0.4 * size)], "key string, source_size bigint, target double")
    c = rows.join(op._expected(rows, tgt, 2.0), ["key", "bin"]).collect()
    q = {r["doc_id"]: (r["u"] / (1 - r["u"])) / (r["p"] / (1 - r["p"])) for r in c}
    assert len({r["p"] for r in c}) > 100 and not any(r["copies"] for r in c)
    taken = {r["doc_id"] for r in op.draw(rows, tgt).collect() if r["copies"]}
    assert max(q[d] for d in taken) < min(q[d] for d in q if d not in taken)
    assert abs(sum(r["size"] for r in c if r["doc_id"] in taken) - 0.4 * size) <= 300
