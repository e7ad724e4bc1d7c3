"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text has the features "contains this word" and "contains a word that begins
so" (4, 5 and 6 letters).  The model has one weight for each feature, shared
by all grades, and ordered thresholds: P(grade <= k) = 1 / (1 + exp(w.x - t_k)).
Its output is the expected grade, the sum over k of P(grade > k); a text is
toxic if grade 1 or more has a probability of at least ``CUT``, below one half
as clean texts lie near 0 and a single telling word is enough.

Labels say toxic or not; the grades 1 to 3 of toxic texts are thirds by the
number of different words in them that toxic training texts use at least
``TELLING`` times as often as clean ones.
Vocabulary, grades and weights come from a bounded sample of labelled
texts (``max_sample``); the likelihood's gradient is summed by Spark tasks, each
over its part of the sample (rows of equal grade and features count as one
with a weight), and L-BFGS steps are taken on the driver, on as many numbers as
the vocabulary has (``max_features``).  Sums are rounded to
fixed point before they meet, so that reruns agree.

Defined cases: null and empty texts have no features and get the severity of
such a text; repeated rows stay; without toxic or without clean labels every
severity is 0; an empty table gives no rows; other columns are ignored; whole
texts are read, of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Memo, give_back, read_table, save, slices, tidy, unit_hash, with_workers

#: Lengths of word beginnings, grades of toxic texts, and the probability from which a text is toxic.
PREFIXES, GRADES, CUT = (4, 5, 6), 3, 0.3
#: A feature needs so many texts and this chi squared; a telling one is so much more frequent in toxic texts.
LEAST_DOCS, LEAST_CHI, TELLING = 5, 25.0, 10.0
#: Passes and remembered steps of L-BFGS, and its ridge.
STEPS, MEMORY, RIDGE = 60, 10, 1e-5
#: Bytes of the words that a worker remembers.
WORDS = 24 << 20
#: Sums are rounded to 2**-32.
UNIT = float(1 << 32)


def features_of(word: str) -> list[str]:
    """The word, and its proper beginnings marked by a hyphen."""
    return [word, *[f"{word[:k]}-" for k in PREFIXES if len(word) > k]]


@dataclass
class SeverityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def reader(self) -> Memo:
        """word -> numbers of its features in the vocabulary."""
        known = self.vocabulary
        return Memo(lambda w: [known[f] for f in features_of(w) if f in known], WORDS)


def _numbers(text: str | None, memo: Memo) -> list[int]:
    return sorted(set().union(*map(memo.__getitem__, set(WORD.findall(text.lower()))))) if text else []


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def likelihood(features: list[list[int]], grades: np.ndarray, times: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The log likelihood of rows that count ``times`` each, and its gradient
    for the weights and the thresholds."""
    n = np.array([len(f) for f in features])
    flat = np.fromiter((x for f in features for x in f), np.int64, n.sum())
    rows = np.repeat(np.arange(len(n)), n)
    eta = np.bincount(rows, weights[flat], minlength=len(n))
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    up, low = _logistic(edges[grades + 1] - eta), _logistic(edges[grades] - eta)
    up[grades == len(thresholds)], low[grades == 0] = 1.0, 0.0
    p = np.maximum(up - low, 1e-300)
    by_eta = times * (up + low - 1)
    by_edge = np.zeros(len(thresholds) + 2)
    np.add.at(by_edge, grades + 1, times * up * (1 - up) / p)
    np.add.at(by_edge, grades, -times * low * (1 - low) / p)
    return np.concatenate([[(times * np.log(p)).sum()], np.bincount(flat, by_eta[rows], minlength=len(weights)), by_edge[1:-1]])


def severity(features: list[list[int]], model: SeverityModel) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= 1) of each row."""
    eta = np.array([model.weights[f].sum() for f in features])
    above = _logistic(eta[:, None] - model.thresholds[None, :])
    return above.sum(axis=1), above[:, 0]


def _vocabulary(sample: DataFrame, max_features: int) -> tuple[dict[str, int], set[str]]:
    """The features that differ most, and beyond chance (chi squared),
    between toxic and clean texts, and the telling ones among them."""

    def counts(batches):
        for batch in slices(batches):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            memo = Memo(features_of, WORDS)
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(set().union(*map(memo.__getitem__, set(WORD.findall(text.lower())))))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["feature", "a", "b"])

    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    sums = sample.select("text", "toxic").mapInArrow(tidy(counts), "feature string, a bigint, b bigint").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b + 1) * n1 * n0)
    best = sums.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.col("chi").desc(), "feature").limit(max_features)
    rows = best.collect()  # at most max_features
    return {r["feature"]: i for i, r in enumerate(rows)}, {r["feature"] for r in rows if r["a"] / n1 >= TELLING * r["b"] / n0}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_sample: int = 20_000, max_features: int = 4096) -> SeverityModel | None:
    """Learn from at most about ``max_sample`` labelled texts, half of them
    toxic if there are so many, chosen by the hash of doc_id."""
    with_workers(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    some = {k: min(1.0, max(max_sample / 2, max_sample - n[1 - k]) / n[k]) for k in n}
    chosen = known.where(unit_hash("doc_id", seed=5) < F.when(F.col("toxic") == 1, some[1]).otherwise(some[0])).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # Sent to the texts, as there are about max_sample of them at most.
    sample = save(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    both = sample.agg(F.min("toxic"), F.max("toxic")).first()
    if both[0] != 0 or both[1] != 1:
        return None
    vocabulary, telling = _vocabulary(sample, max_features)
    model = SeverityModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(GRADES))

    def read(batches):
        memo = model.reader()
        told = Memo(lambda w: any(f in telling for f in features_of(w)), WORDS)
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            load = [float(sum(map(told.__getitem__, set(WORD.findall(t.lower()))))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(load), pa.array([_numbers(t, memo) for t in texts], pa.list_(pa.int32()))], ["toxic", "load", "features"])

    rows = sample.mapInArrow(tidy(read), "toxic int, load double, features array<int>")
    rows = save(rows)
    cuts = rows.where("toxic = 1").agg(F.percentile("load", F.array(*[F.lit(k / GRADES) for k in range(1, GRADES)]))).first()[0]
    grade = F.when(F.col("toxic") == 0, 0).otherwise(1 + sum(((F.col("load") > c).cast("int") for c in cuts), F.lit(0))).cast("int")
    graded = save(rows.select(grade.alias("grade"), "features").groupBy("grade", "features").count())
    count = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.sum("count").alias("n")).collect()}
    total = sum(count.values())
    share = np.cumsum([count.get(k, 0) + 1 for k in range(GRADES)]) / (total + GRADES + 1)
    model.thresholds = np.log(share / (1 - share))
    _climb(graded, model, total)
    return model


def _climb(graded: DataFrame, model: SeverityModel, n: int) -> None:
    """Minimise the mean loss and a ridge by L-BFGS; each value and gradient
    is one pass.  Thresholds stay ordered: all but the first are steps, kept
    by their logarithms."""
    k = len(model.weights)

    def thresholds(x):
        return x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))])

    def loss(x):
        w, t = x[:k], thresholds(x)

        def part(batches):
            total = np.zeros(1 + len(w) + len(t))
            for b in batches:
                total += likelihood(b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), w, t)
            yield pa.RecordBatch.from_arrays([pa.array([np.round(total * UNIT).astype(np.int64).tolist()], pa.list_(pa.int64()))], ["g"])

        parts = graded.coalesce(4).mapInArrow(part, "g array<bigint>").collect()  # 4 rows
        got = sum(np.array(r["g"], dtype=np.int64) for r in parts) / UNIT / n
        by_t = got[1 + k :]
        later = np.cumsum(by_t[::-1])[::-1]
        g = -np.concatenate([got[1 : 1 + k], [later[0]], later[1:] * np.exp(x[k + 1 :])])
        g[:k] += RIDGE * w
        return -got[0] + RIDGE / 2 * (w @ w), g

    t = model.thresholds
    x = np.concatenate([model.weights, t[:1], np.log(np.maximum(np.diff(t), 1e-6))])
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    tries, step = 1, min(1.0, 1 / np.abs(g).sum())
    while tries < STEPS and np.abs(g).max() > 1e-7:
        d, at = -g, []
        for s, y in reversed(pairs):
            at.append(s @ d / (s @ y))
            d = d - at[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(at), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        while True:
            new = x + step * d
            new_value, new_g = loss(new)
            tries += 1
            if new_value <= value + 1e-4 * step * (g @ d) or tries >= STEPS:
                break
            step /= 3
        if new_value > value:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y)][-MEMORY:]
        x, value, g, step = new, new_value, new_g, 1.0
    model.weights, model.thresholds = x[:k], thresholds(x)


def scorer(model: SeverityModel | None):
    """A column function: text to (severity, p_toxic)."""
    kind = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = model.reader() if model else None
        for text in batches:
            e = p = np.zeros(len(text))
            if model:
                e, p = severity([_numbers(t if isinstance(t, str) else None, memo) for t in text], model)
            yield pd.DataFrame({"severity": e, "p_toxic": p})
        del memo
        give_back()

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fit_options) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row: expected grade, the
    same rounded, and the verdict."""
    run = scorer(fit(docs, labels, doc_id, text, **fit_options))
    rows = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("p"))
    return rows.select("doc_id", F.round("p.severity", 9).alias("severity"), F.round("p.severity").cast("int").alias("grade"), (F.col("p.p_toxic") >= CUT).alias("toxic"))


def query(spark, sf_dir):
    """Severity of every whole document."""
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
