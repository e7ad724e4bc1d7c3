import random

from logweave.operators.dedupe import dedupe
from logweave.operators.firsts import first_per_group


def test_first_per_group_matches_sorted_scan(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}"   # one key holds ~40% of rows
        rows.append((k, rnd.choice(["b.log", "a.log", "c.log"]), i, f"v{i}"))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, source string, line_no long, val string").repartition(6)
    got = {r.key: (r.source, r.line_no, r.val, r.n) for r in first_per_group(df, ["key"], ["source", "line_no", "val"]).collect()}
    want = {}
    for k, s, l, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in want:
            want[k] = [s, l, v, 0]
        want[k][3] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    d = {r.key: (r.source, r.line_no, r.dup_count) for r in dedupe(df, ["key"], keep=[]).collect()}
    assert d == {k: (v[0], v[1], v[3]) for k, v in want.items()}
    d2 = {r.key: r.val for r in dedupe(df, ["key"], keep=["val"]).collect()}
    assert d2 == {k: v[2] for k, v in want.items()}


def test_first_per_group_null_source(spark):
    df = spark.createDataFrame([("k", None, 5, "a"), ("k", "s", 1, "b"), ("j", None, None, "c")],
                               "key string, source string, line_no long, val string")
    got = {r.key: (r.source, r.line_no, r.val, r.n) for r in first_per_group(df, ["key"], ["source", "line_no", "val"]).collect()}
    assert got == {"k": (None, 5, "a", 2), "j": (None, None, "c", 1)}
