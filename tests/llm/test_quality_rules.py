import random
import re
from collections import Counter, defaultdict

from logweave.llm import quality_rules as op

from .conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[ \t\x0b\x0c\r]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def brute(rows, min_texts=op.MIN_TEXTS, share=op.SHARE, left=op.LEFT):
    """(doc_id, text, source) rows to results, by the definitions."""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text)
        for line in (text or "").split("\n"):
            holders[host, normal(line)].add(text)
    common = {k for k, v in holders.items() if k[1] and len(v) > max(min_texts, share * len(texts[k[0]]))}
    out = []
    for doc_id, text, host in rows:
        t = text or ""
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        removed = sum(len(WORD.findall(x)) for x in full if (host, normal(x)) in common)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        kept = not failed and not len(w) - removed < left * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again), failed, kept, removed))
    return out


def same(docs, **options):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in op.judge(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **options), key=str)
    return got


def corpus(rng):
    words = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    foot = ["All  Rights reserved, 2024 # %", "Cookie notice: " + line(45), "Read more"]
    rows = []
    for i in range(240):
        body = [line(rng.randint(3, 30)) for _ in range(rng.randint(0, 6))]
        body += [rng.choice(foot).replace("2024", str(1990 + i % 30)) for _ in range(rng.randint(0, 3))]
        body += body[:1] * (i % 7 == 0)
        rng.shuffle(body)
        rows.append((i, rng.choice(["\n", "\r\n", "\n\n"]).join(body), "en", rng.choice(["a", "a", "b", None])))
    rows += [(1000 + i, line(5) + "\n" + rows[0][1] + " " + line(60), "en", "n") for i in range(3)]
    copy = line(80)  # many copies of a text are one text
    return rows + [(2000 + i, copy, "en", "a") for i in range(60)]


def test_rules_are_those_of_the_definition(spark):
    docs = documents(spark, corpus(random.Random(4)))
    got = same(docs)
    assert sum(r[8] > 0 for r in got) > 50 and sum(not r[6] and not r[7] for r in got) > 3
    assert all(r[7] for r in got if (r[0] or 0) >= 2000)
    same(docs, min_texts=2, share=0.2)


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = same(odd_docs)
    assert [r[7] for r in got if r[0] in (0, 1, 2)] == [False] * 3
    assert op.judge(no_docs).collect() == []


def test_repeated_windows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))), "en", "s") for i in range(150)]
    same(documents(spark, rows))


def test_cleaned_removes_the_lines(spark, odd_docs):
    rng = random.Random(4)
    rows = corpus(rng)
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in op.cleaned(docs).collect()}
    removed = {r["doc_id"]: r["removed"] for r in op.judge(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, _ in rows:
        new = got[doc_id]["text"]
        assert len(WORD.findall(new)) == len(WORD.findall(text)) - removed[doc_id]
        assert new == text if not removed[doc_id] else "word" in new or not WORD.findall(new)
    assert op.cleaned(docs).columns == docs.columns
    before = sorted(map(str, odd_docs.collect()))
    assert sorted(map(str, op.cleaned(odd_docs).collect())) == before


def test_plan_is_native(spark):
    plan = op.judge(documents(spark, corpus(random.Random(4))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
