import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from logweave.llm import collocations as op
from logweave.llm.quotient_filter import Filter, Packing, blocks, counted

from .conftest import documents


@pytest.mark.parametrize("size,bits", [(2, 1), (2, 7), (2, 40), (3, 1), (3, 8), (3, 21), (3, 40)])
def test_packing_and_permutation_are_invertible(size, bits):
    rng = np.random.default_rng(bits)
    p = Packing(size, bits)
    ids = [rng.integers(0, 1 << bits, 500) for _ in range(size)]
    left, right = p.permute(*p.pack(ids))
    assert all((a == b).all() for a, b in zip(p.unpack(*p.restore(left, right)), ids, strict=True))
    different = {tuple(x) for x in zip(*(i.tolist() for i in ids), strict=True)}
    assert len(set(zip(left.tolist(), right.tolist(), strict=True))) == len(different)


@pytest.mark.parametrize("size,bits,prefix", [(2, 9, 0), (2, 9, 3), (3, 5, 4), (3, 30, 2), (2, 40, 6)])
def test_filters_count_and_merge_without_loss(size, bits, prefix):
    rng = np.random.default_rng(3)
    p, total, shards = Packing(size, bits), Counter(), []
    for _ in range(4):
        ids = [rng.integers(1, 1 << min(bits, 6), 3000) for _ in range(size)]
        for j in range(size):
            ids[j][:700] = j + 1  # a counter above 254
        total.update(zip(*(i.tolist() for i in ids), strict=True))
        shards += [(f.block, f.dump()) for f in blocks(p, prefix, *counted(*p.permute(*p.pack(ids))))]
    got = {}
    for block in {b for b, _ in shards}:
        f = Filter.merge([Filter.load(p, prefix, block, d) for b, d in shards if b == block])
        assert Filter.load(p, prefix, block, f.dump()).counts.tolist() == f.counts.tolist()
        got |= dict(zip(zip(*(k.tolist() for k in f.keys()), strict=True), f.counts.tolist(), strict=True))
    assert got == dict(total)


def test_filter_is_compact():
    rng = np.random.default_rng(4)
    p = Packing(3, 17)
    (f,) = blocks(p, 0, *counted(*p.permute(*p.pack([rng.integers(1, 1 << 17, 100_000) for _ in range(3)]))))
    assert len(f.dump()) < 8.5 * len(f.counts)  # 51 bits of key: 2 + 4 bytes, 1 of counter, 2 or 3 bits


def brute(rows, least, top):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    f = {k: Counter() for k in (1, 2, 3)}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            for k in f:
                f[k].update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {g: a for k in (2, 3) for g, a in f[k].items() if a >= least}
    n, out = Counter(), []
    for g, a in f[1].items():
        n[g[0]] += a
    for (lang, *w), a in often.items():
        if len(w) == 2 and any(100 * b >= 50 * a for g, b in often.items() if g[0] == lang and len(g) == 4 and tuple(w) in (g[1:3], g[2:4])):
            continue
        cuts = [(1_000_000 * a * a // (x * y), k, x, y) for k in range(1, len(w)) for x, y in [(f[k][(lang, *w[:k])], f[len(w) - k][(lang, *w[k:])])]]
        s, _, x, y = min(cuts)
        out.append((lang, -s, -a, " ".join(w).encode(), x, y))
    rank, got = Counter(), []
    for lang, s, a, phrase, x, y in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, x, y, n[lang], -s))
    return got


def sample(rng):
    words = ["New", "york", "CITY", "the", "of", "ä", "x y", "z\x01", "re"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 80)))
    return [(i, text(), rng.choice(["en", "de", None]), "s") for i in range(80)] + [(500, None, "en", "s"), (501, "", None, "s"), (502, "lone", "fr", "s")]


@pytest.mark.parametrize("options", [{}, {"chunk": 50, "per_block": 100}])
def test_collocations_are_those_of_the_definition(spark, options):
    rows = sample(random.Random(6))
    rows += rows[:5]  # repeated rows
    want = brute([(r[1], r[2]) for r in rows], 10, 25)
    got = sorted((tuple(r) for r in op.collocations(documents(spark, rows), top=25, **options).collect()), key=lambda r: r[:2])
    assert got == sorted(want, key=lambda r: r[:2]) and len(got) > 40


def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdef") for _ in range(5000))
    b = op.Buffer()
    monkeypatch.setattr(op, "SLICE", 100)
    b.add(long.encode())
    starts, counts = 0, Counter()
    for n, _, words, c in b.rows(64):
        starts += n
        counts.update(dict(zip(words, c, strict=True)))
    assert starts == 5001 and counts == Counter(x.encode() for x in long.split())


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in op.collocations(odd_docs).collect())
    assert got == sorted(brute(rows, 10, 2000))
    assert op.collocations(no_docs).collect() == []


def test_sql_is_the_definition():
    con = duckdb.connect()
    rows = sample(random.Random(9))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(op.ORACLE).fetchall()) == sorted(brute([(r[1], r[2]) for r in rows], op.LEAST, op.TOP))
