import random
import zlib
from collections import Counter, defaultdict

from logweave.llm import sharding as op

from .conftest import documents


def test_tree_is_best_fit_decreasing():
    rng = random.Random(1)
    items = [(f"i{k}", rng.randint(1, 60)) for k in range(500)]
    rooms, want = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = min(((r, n) for n, r in enumerate(rooms) if r >= size), default=None)
        if fit is None:
            rooms.append(100)
            fit = (100, len(rooms) - 1)
        rooms[fit[1]] -= size
        want[name] = fit[1]
    assert op.best_fit_decreasing(items, 100) == want


def test_tree_stays_balanced():
    tree = op.RoomTree()
    for k in range(4096):
        tree.insert(k, k)
    for k in range(0, 2000):
        assert tree.take(k)[0] >= k

    def depth(t):
        return 1 + max(depth(t.left), depth(t.right)) if t else 0

    assert depth(tree.root) <= 24


def test_pack_needs_no_more_bins_than_shards():
    items = [(f"i{k}", 1 + k % 37) for k in range(4000)]
    place = op.pack(items, 40)
    load = Counter()
    for name, size in items:
        load[place[name]] += size
    assert len(load) == 40 and max(load.values()) <= 1.01 * sum(load.values()) / 40


def check(docs, shards, split=()):
    rows = docs.collect()
    got = op.shard(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r["doc_id"], size(r["text"]), crc(r["text"])) for r in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    slots, group = defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        group[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {k for k, v in group.items() if len(v) > 1} <= set(split)
    return got


def test_shards_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs, 40)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 40 and max(load.values()) <= 1.02 * min(load.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    docs = documents(spark, [(i, "hot text " * 20, "en", "a") for i in range(400)] + [(1000 + i, f"text {i} " * (i % 9 + 1), "en", "a") for i in range(600)])
    text = "hot text " * 20
    got = check(docs, 10, {(len(text) + 16, zlib.crc32(text.encode()))})
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.25 * min(load.values())


def test_odd_rows(odd_docs, no_docs):
    texts = [(len((r["text"] or "").encode()) + 16, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in odd_docs.collect()]
    check(odd_docs, 3, texts)
    assert op.shard(no_docs, 40).count() == 0
