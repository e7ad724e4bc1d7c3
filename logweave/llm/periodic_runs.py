"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words in which words ``q`` apart are equal,
``q`` the smallest such number, which no neighbouring word extends, and which is
at least ``max(12, 2 * q)`` words long.

The dictionary names every factor whose length is a power of two: equal factors
have equal names, and a name of one level is made from two names of the level
below.  Level ``L`` proposes the periods from ``L`` up to ``2 * L``.  Occurrences of
one factor that follow each other within ``L / 2`` are all the same distance
apart, so each name's occurrences fall into arithmetic progressions, and
occurrences further apart than that begin a new one.  A run of period ``q`` holds
its first factor of length ``L <= q < 2 * L`` twice, ``q`` apart, in two different
progressions (within one, a smaller period would divide ``q``).  So the
distances between two progressions that begin within ``2 * L`` of each other are
the proposals; of those at one distance, one is enough, as their factors
overlap.  A proposal is extended to both sides by halving steps through the
dictionary; the interval is kept if it is long enough, and of equal intervals
the smallest period stays.  Levels end where no factor occurs twice.

Texts of a batch are put together with a border of its own after each, so that
no factor reaches over a border; a worker holds about ``WORDS`` words at a time,
or one text, with some 100 bytes a word.

Defined cases: a null text has no words; a text without runs has 0 of them, and
its words stay; a null doc_id plants nothing; repeated rows stay; an empty table
gives no rows; other columns are carried along by ``with_runs`` and ``collapse``
(columns of the names that they add are replaced; null text collapses to null) and ignored by the query;
texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, tidy, with_workers

#: Words of a batch that are looked at together.
WORDS = 300_000
LEAST = 12

Rewrite = Callable[[object, list[bytes]], list[bytes]]


class Factors:
    """Names of all factors of power-of-two lengths of ``word``, a sequence
    of numbers: ``names[k][i]`` is that of the 2**k words from i on."""

    def __init__(self, word: np.ndarray):
        self.names = [np.unique(word, return_inverse=True)[1].astype(np.int32)]
        while self._deepen():
            pass

    def _deepen(self) -> bool:
        """Name the factors of twice the length, unless none is that long
        or none of the present ones occurs twice."""
        last, half = self.names[-1], 1 << len(self.names) - 1
        m = len(last) - half
        if m <= 0 or int(last.max()) + 1 == len(last):
            return False
        pair = last[:m].astype(np.int64) * (int(last.max()) + 1) + last[half : half + m]
        self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        return True

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the factors of a level at a and b are there and equal."""
        names = self.names[level]
        there = (a >= 0) & (b < len(names))
        out = np.zeros(len(a), bool)
        out[there] = names[a[there]] == names[b[there]]
        return out

    def forward(self, a: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """First place from ``a`` on whose word differs from the one
        ``distance`` further on."""
        a = a.copy()
        for level in range(len(self.names) - 1, -1, -1):
            a[self.same(level, a, a + distance)] += 1 << level
        return a

    def backward(self, a: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Least place from which on words equal those ``distance`` further
        on up to ``a``."""
        a = a.copy()
        for level in range(len(self.names) - 1, -1, -1):
            a[self.same(level, a - (1 << level), a - (1 << level) + distance)] -= 1 << level
        return a

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period): factors of a level that occur again so much
        further on, for periods from the level's length up to twice it."""
        length, names = 1 << level, self.names[level]
        place = np.argsort(names, kind="stable")
        name = names[place]
        begins = np.ones(len(place), bool)
        begins[1:] = (name[1:] != name[:-1]) | (np.diff(place) > length // 2)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(place)) - 1
        a, e, own = place[first], place[last], name[first]
        step = np.where(last > first, place[np.minimum(first + 1, len(place) - 1)] - a, 0)
        places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(1, len(first)):
            x = np.flatnonzero((own[r:] == own[:-r]) & (a[r:] - e[:-r] < 2 * length))
            if not len(x):
                break
            # Distances from the last of x to the first of y, and on by steps, to that from the first of x to the last of y.
            y = x + r
            by = np.maximum(step[x], step[y])
            low, high = a[y] - e[x], np.minimum(e[y] - a[x], 2 * length - 1)
            low += np.where(by > 0, np.maximum(0, -(-(length - low) // np.maximum(by, 1))) * by, 0)
            n = np.where((low >= length) & (high >= low), 1 + np.where(by > 0, (high - low) // np.maximum(by, 1), 0), 0)
            which = np.repeat(np.arange(len(x)), n)
            q = low[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * by[which]
            places.append(np.maximum(a[x][which], a[y][which] - q))
            periods.append(q)
        return np.concatenate(places), np.concatenate(periods)


def find_runs(word: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of every run, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(word) < max(2, least):
        return none
    factors, found = Factors(word), [none]
    for level in range(len(factors.names)):
        at, q = factors.proposals(level)
        if len(at):
            start = factors.backward(at, q)
            length = factors.forward(at + (1 << level), q) - start + q
            keep = length >= np.maximum(least, 2 * q)
            found.append(np.stack([start[keep], length[keep], q[keep]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one interval, the smallest period
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of every list of words."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    for k, (words, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        codes[end - len(words) - 1 : end - 1] = [number.setdefault(w, len(number)) for w in words]
        codes[end - 1] = -1 - k  # a border like no other
    rows = find_runs(codes, least)
    begins = ends - sizes - 1
    of = np.searchsorted(ends, rows[:, 0], "right")
    rows[:, 0] -= begins[of]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than blanks and U+0009 to U+000D, in UTF-8."""
    return [] if text is None else text.encode().split()


def _groups(texts, ids, rewrite: Rewrite | None):
    """Words of texts, so many texts at a time as have about WORDS words."""
    group, size = [], 0
    for text, i in zip(texts, ids, strict=True):
        words = words_of(text.as_py())
        if rewrite is not None:
            words = rewrite(i.as_py(), words)
        if group and size + len(words) > WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _added(df: DataFrame, text: str, fields: list[T.StructField], make, least: int, key: str | None = None, rewrite: Rewrite | None = None) -> DataFrame:
    """``df`` and the columns that ``make`` gives for each row's words and runs
    and whether its text is there, in place of columns of the same names."""
    with_workers(df.sparkSession)
    names = [f.name for f in fields]
    at, by = df.columns.index(text), df.columns.index(key or text)
    keep = [i for i, c in enumerate(df.columns) if c not in names]
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            done = 0
            for group in _groups(batch.column(at), batch.column(by), rewrite):
                part = batch.slice(done, len(group))
                done += len(group)
                there = part.column(at).is_valid().to_pylist()
                made = [make(*row) for row in zip(group, runs_of(group, least), there, strict=True)]
                new = [pa.array(list(col), kind) for col, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *new], [*[part.schema.names[i] for i in keep], *names])

    return df.mapInArrow(tidy(run), T.StructType([*[df.schema.fields[i] for i in keep], *fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string()}.get(kind.simpleString()) or pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def with_runs(df: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs") -> DataFrame:
    """``df`` with the list of each text's runs, by start, then period."""
    as_rows = lambda found: [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()]
    return _added(df, text, [T.StructField(runs, RUNS)], lambda words, found, there: [as_rows(found)], least)


def collapse(df: DataFrame, text: str = "text", least: int = LEAST, collapsed: str = "collapsed") -> DataFrame:
    """``df`` with each text's words, joined by one blank, without those
    that lie in a run after its first period (null stays null)."""
    return _added(df, text, [T.StructField(collapsed, T.StringType())], lambda words, found, there: [_collapsed(words, found).decode() if there else None], least)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    drop = repeats(len(words), runs).tolist()
    return b" ".join([w for w, d in zip(words, drop, strict=True) if not d])


def plant(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document with a repeated stretch put into every tenth
    by the CRC of its id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _digest(words: list[bytes], runs: np.ndarray, there: bool) -> list:
    rows = runs.tolist()
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if rows else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return [len(rows), *best, milli, sha256(listed.encode()).hexdigest(), sha256(_collapsed(words, runs)).hexdigest()]


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256): the greatest run of every text and digests of all runs
    and of the collapsed text.  ``rewrite`` gives the words to look at, from
    doc_id and a text's words."""
    long, string = T.LongType(), T.StringType()
    kinds = {"n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long, "runs_sha256": string, "collapsed_sha256": string}
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _added(rows, "text", [T.StructField(k, v) for k, v in kinds.items()], _digest, least, "doc_id", rewrite).drop("text")


def query(spark, sf_dir):
    """Runs of every whole document, a tenth of them with a planted one."""
    return digest(read_table(spark, sf_dir, "documents"), rewrite=plant)
