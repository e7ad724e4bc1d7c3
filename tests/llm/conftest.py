import random

import pytest

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, `key` string, `set` string, n int, tkey string, u double, word string, p string, `_row` string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names
    operators use inside."""
    full = [(*r, len(r[1] or ""), "x", "x", "x", 1, "x", 0.5, "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, EXTRA)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and
    repeated rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = prose(rng, words, 30_000)
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "b"), (3, "!!! ???", "de", None), (4, long, "en", "a"),
        (5, long + " tail", "en", "b"), (6, "one two three", "en", "a"), (7, "one two three", "en", "b"), (None, "null id here", "en", "a"),
        (None, None, None, None), (8, "same row again", "de", "c"), (8, "same row again", "de", "c"), (8, "same row again", "de", "c"),
        (9, "x" * 50_000, "en", "c"), (10, "日本語のテキスト 🙂 \x00 end", None, "d"), (11, "one two three", "en", "a"),
    ]
    rows += [(100 + i, prose(rng, words, 40), "en", "abc"[i % 3]) for i in range(30)]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
