import os

from logweave.llm import common


def test_memo_is_bounded_by_bytes():
    made = []
    memo = common.Memo(lambda k: made.append(k) or k * 1000, 1 << 20)
    for i in range(4000):
        assert memo[f"{i % 700}x"] == f"{i % 700}x" * 1000
        assert memo.held < 1 << 20 and len(memo) < 400
    assert len(made) > 700  # it started anew more than once
    memo.forget()
    assert not memo and memo.held == 0


def test_tidy_gives_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == [1]

    def broken(batches):
        yield 1
        raise ValueError

    try:
        list(common.tidy(broken)([]))
    except ValueError:
        assert calls == [1, 1]


def test_scratch_keeps_the_last_table(spark):
    with common.scratch():
        first = common.save(spark.range(3).toDF("a"))
        with common.scratch():
            inner = common.save(first.selectExpr("a + 1 AS a"))
            last = common.save(inner.selectExpr("a * 2 AS a"))
        assert first.count() == 3
    folder = os.path.dirname(last.inputFiles()[0]).removeprefix("file://")
    assert sorted(r["a"] for r in last.collect()) == [2, 4, 6] and os.path.isdir(folder)
    assert _gone(first) and _gone(inner)


def _gone(df):
    try:
        df.collect()
    except Exception:  # noqa: BLE001 - its files are deleted
        return True
    return False
