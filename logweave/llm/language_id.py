"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
trigram is bound from its letters, the first rotated twice, the second once,
multiplied element by element.  A text is the bundle (sum) of its trigrams,
letters lower-cased and everything else one blank; a language is the bundle of
its training texts, each of length 1.  A text gets the language of the
largest cosine, ties by code point.

Vectors of counts are whole numbers, and training sums are kept as whole
numbers too, so results don't depend on batches or partitions.

Defined cases: null text and text without a letter give ``und`` and score 0, as
does every text when there is nothing to learn from; a negative cosine is
score 0; repeated rows stay; an empty table gives no rows; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, read_table, save, slices, tidy, unit_hash, with_workers

#: A text in no learned language has a cosine of deviation 1/sqrt(DIM) with a
#: prototype.
DIM, SEED, UNKNOWN = 4096, 20, "und"
#: Texts and characters bundled at a time, trigrams multiplied at a time, and
#: texts whose bundles are held at a time.
TEXTS, CHARS, COLUMNS, ROWS = 64, 200_000, 1024, 250
#: Trigrams of an alphabet that are counted in a table of all of them.
DENSE = 1 << 18
#: Training sums are in units of 2**-24.
UNIT = float(1 << 24)


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(1024)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter (0: the blank)."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIM, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def bundles(texts: list[str | None]) -> np.ndarray:
    """The bundle of each text, a row of DIM whole numbers."""
    out = np.zeros((len(texts), DIM))
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and (i - first == TEXTS or size + n > CHARS):
            out[first:i] = _bundle(texts[first:i])
            first, size = i, 0
        size += n
    if first < len(texts):
        out[first:] = _bundle(texts[first:])
    return out


def _bundle(texts: list[str | None]) -> np.ndarray:
    low = [f"\n{t.lower()}\n" if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.int64)
    docs = np.repeat(np.arange(len(texts)), [len(t) for t in low])
    out = np.zeros((len(texts), DIM))
    if not len(codes):
        return out
    letter = _is_letter()[codes]
    codes[~letter] = 0
    after = np.concatenate([[False], letter[:-1] | (docs[1:] != docs[:-1])])
    after[0] = True
    keep = letter | after  # of a run of other characters, the first
    codes, docs = codes[keep], docs[keep]
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    x, n = place[codes], len(alphabet)
    same = docs[2:] == docs[:-2]
    tri, docs = ((x[:-2] * n + x[1:-1]) * n + x[2:])[same], docs[2:][same]
    if n**3 <= DENSE:
        used = np.flatnonzero(np.bincount(tri, minlength=1))
        at = np.zeros(n**3, np.int64)
        at[used] = np.arange(len(used))
        tri = at[tri]
    else:
        used, tri = np.unique(tri, return_inverse=True)
    vectors = np.stack([letter_vector(int(c)) for c in alphabet])
    one, two = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    kind = np.float32 if len(codes) < 1 << 24 else np.float64  # whole numbers stay exact
    for a in range(0, len(used), COLUMNS):
        cols = used[a : a + COLUMNS]
        bound = two[cols // (n * n)] * one[cols // n % n] * vectors[cols % n]
        here = (tri >= a) & (tri < a + len(cols)) if len(used) > COLUMNS else slice(None)
        counts = np.bincount(docs[here] * len(cols) + tri[here] - a, minlength=len(texts) * len(cols)).reshape(len(texts), len(cols))
        out += counts.astype(kind) @ bound.astype(kind)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    letters = _is_letter()
    some = [bool(t) and (any(map(str.isalpha, t[:64])) or bool(letters[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any())) for t in texts]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosine = np.concatenate([np.zeros((0, len(langs)))] + [unit(bundles(texts[a : a + ROWS])) @ prototypes.T for a in range(0, len(texts), ROWS)])
    best = cosine.argmax(axis=1)
    score = np.where(some, np.clip(np.round(cosine[np.arange(len(texts)), best], 9), 0, 1), 0.0)
    return [langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_per_lang: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from at most about ``max_per_lang``
    texts for each language, chosen by the hash of doc_id, that are not held
    out and whose language is known."""
    with_workers(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not n:
        return [], np.zeros((0, DIM))
    share = F.create_map(*[F.lit(x) for lang, count in sorted(n.items()) for x in (lang, max_per_lang / count)])
    chosen = rows.where(unit_hash("doc_id", seed=9) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, ROWS):
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            v = np.round(unit(bundles(batch.column(1).to_pylist())) * UNIT).astype(np.int64)
            for name in set(names):
                total[name] = total.get(name, 0) + v[names == name].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = chosen.mapInArrow(tidy(sums), "lang string, v array<bigint>")
    table = save(parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")))
    got = table.orderBy("lang", "pos").collect()  # DIM numbers for each language
    langs = [r["lang"] for r in got[::DIM]]
    return langs, unit(np.array([r["x"] for r in got], dtype=np.float64).reshape(len(langs), DIM))


def identifier(langs: list[str], prototypes: np.ndarray):
    """A column function: text to (lang, score)."""

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            names, score = predict([None if t is None or t != t else t for t in text], langs, prototypes)
            yield pd.DataFrame({"lang": names, "score": score})
        give_back()

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit_options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    run = identifier(*fit(docs, doc_id, text, lang, **fit_options))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), run(F.col(text)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def query(spark, sf_dir):
    """The language of every whole document."""
    return identify(read_table(spark, sf_dir, "documents"))
