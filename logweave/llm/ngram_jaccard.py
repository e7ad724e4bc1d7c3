"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH).

Texts are linked whose sets of five-word shingles have a Jaccard similarity of
at least 0.8.  The steps:

1. Every text becomes its set of shingle hashes; equal sets are one class.
   512 MinHash values of a set are folded into 64 bands of 8.  A pair at the
   threshold shares no band with probability 8e-6, one at 0.85 with 1e-9.
2. Sets that share a band value are joined to the least set of that value, a
   number of edges in proportion to the rows, and connected components of
   these edges bring all candidates of a set together.  Pairs are never rows.
3. Sets in order of their components and least neighbours are cut into blocks
   of bounded size.  A block meets itself and the blocks that it shares a band
   value with; sets of one component are compared.  MinHash values are compared
   32 at a time; a pair goes as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is
   below ``TOLERANCE``.  Pairs left are verified exactly on the shingle sets.
   A task returns, for each set, how many texts it links to and the root of
   its tree in a spanning forest.
4. Components of the forests are the classes.

Words are runs of letters, digits and underscores, lower-cased.  Defined cases: a
text of one to four words has one shingle, of all its words; a text without a
word has one shingle, itself without white space around; null, empty and
blank texts have none and are linked to nothing, each its own class.  Repeated
rows are copies and count as links.  An empty table gives no rows; other
columns are ignored; whole texts are read, of any length.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, global_row_number
from .common import WORD, Memo, join_hot, read_table, save, slices, spread, text_key, tidy, with_workers

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, ROUND = 64, 8, 32
HASHES = BANDS * ROWS
#: Sets of a block, counting one for each UNIT shingles more; blocks of a group; sets numbered together.
BLOCK, UNIT, PACK, RUN = 256, 2000, 4, 100_000
#: Bytes of remembered words and of names of sets.
WORDS, SEEN = 24 << 20, 16 << 20

_random = np.random.Generator(np.random.Philox(key=1))
_TIMES = _random.integers(0, 1 << 63, 2 * N + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FOLD = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TIMES[-1]
    return (x ^ (x >> np.uint64(29))) * _TIMES[-2]


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, WORDS)


def shingles(text: str | None, memo: Memo, n: int = N) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        bare = text.strip() if text else ""
        return np.array([xxhash.xxh64_intdigest(bare, seed=1)] if bare else [], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _TIMES[j]
    return np.unique(_mixed(total))


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set of shingles."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(out, (x[a : a + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    folded = (signature.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=1, dtype=np.uint64)
    return _mixed(folded + np.arange(BANDS, dtype=np.uint64) * _TIMES[0]).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 32, 64, ... compared values, the fewest matches at which the
    posterior P(similarity >= threshold) is still ``tolerance``.  With a uniform
    prior that is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def likely_pairs(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of the signatures) that survive all rounds."""
    matches = np.zeros(len(i), np.int32)
    for r, few in enumerate(least):
        if not len(i):
            break
        part = slice(r * ROUND, (r + 1) * ROUND)
        matches = matches + (left[i, part] == right[j, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= few
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def common(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shingles that the sets of each pair have in common."""
    if len(i) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    a = np.concatenate(left)
    b = np.concatenate(right)
    shared = np.intersect1d(a, b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a, in_b = (np.minimum(at, len(shared) - 1) for at in (at_a, at_b))
    ok_a, ok_b = shared[in_a] == a if len(shared) else np.zeros(len(a), bool), shared[in_b] == b if len(shared) else np.zeros(len(b), bool)
    total = np.zeros((len(left), len(right)))
    for first in range(0, len(shared), 4096):
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        for m, rows, at, ok in ((x, row_a, in_a, ok_a), (y, row_b, in_b, ok_b)):
            here = ok & (at >= first) & (at < first + 4096)
            m[rows[here], at[here] - first] = 1
        total += x @ y.T
    return total[i, j].astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs at or above the threshold: of ``left`` with ``right``, or
    within ``left``.  Pairs are looked at a row of ``left`` at a time."""
    sig_l = np.stack([minhashes(s) for s in left])
    sig_r = sig_l if right is None else np.stack([minhashes(s) for s in right])
    size_l = np.array([len(s) for s in left])
    size_r = size_l if right is None else np.array([len(s) for s in right])
    out_i, out_j = [], []
    for a in range(0, len(left), 64):
        rows = np.arange(a, min(a + 64, len(left)))
        i, j = (x.ravel() for x in np.meshgrid(rows, np.arange(len(size_r)), indexing="ij"))
        near = np.minimum(size_l[i], size_r[j]) >= threshold * np.maximum(size_l[i], size_r[j])
        near &= (i < j) if right is None else True
        i, j = likely_pairs(i[near], j[near], sig_l, sig_r, least)
        out_i.append(i)
        out_j.append(j)
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    both = common(i, j, left, left if right is None else right)
    ok = both / np.maximum(size_l[i] + size_r[j] - both, 1) >= threshold
    return i[ok], j[ok]


def _forest(names: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[str, str, int]]:
    """(set, root of its tree, linked texts) of the sets that have a link."""
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = np.zeros(len(names), np.int64)
    np.add.at(links, i, weights[j])
    np.add.at(links, j, weights[i])
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            if names[a] > names[b]:
                a, b = b, a
            parent[b] = a
    return [(names[x], names[root(x)], int(links[x])) for x in np.flatnonzero(links)]


def _verify(least: list[int], threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, int]] = []
        for _, comp in group.groupby(["comp", "one", "two"], sort=False):
            names, weights = comp["set"].to_numpy(), comp["n"].to_numpy()
            sets = [np.asarray(s, np.int64).view(np.uint64) for s in comp["shingles"]]
            side, (one, two) = comp["block"].to_numpy(), comp[["one", "two"]].iloc[0]
            if one == two:
                i, j = linked(sets, None, least, threshold)
            else:
                a, b = np.flatnonzero(side == one), np.flatnonzero(side == two)
                if not len(a) or not len(b):
                    continue
                i, j = linked([sets[x] for x in a], [sets[x] for x in b], least, threshold)
                i, j = a[i], b[j]
            out += _forest(names, weights, i, j)
        return pd.DataFrame(out, columns=["set", "root", "links"]).astype({"set": str, "root": str, "links": "int64"})

    return run


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tkey, set, h, units, bands) of every row, written once; copies
    of a set that a task has met carry no bands."""
    with_workers(docs.sparkSession)

    def run(batches):
        memo, seen = word_hashes(), Memo(lambda k: None, SEEN)
        for batch in slices(batches):
            keys, units, folded = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, memo)
                key = set_key(s)
                new = key is not None and key not in seen
                if new:
                    seen[key]
                keys.append(key)
                units.append(1 + len(s) // UNIT)
                folded.append(bands(minhashes(s)) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k and k.hex() for k in keys], pa.string()), pa.array([None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.array(units, pa.int64()), pa.array(folded, pa.list_(pa.int64()))],
                ["doc_id", "tkey", "set", "h", "units", "bands"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return save(rows.mapInArrow(tidy(run), f"doc_id {kind}, tkey binary, `set` string, h bigint, units bigint, bands array<bigint>"))


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, h): the band values that sets share, and the sets; and (h, comp,
    low) of these sets: their component by shared bands, and the least set that
    one shares a band with."""
    some = rows.where("bands IS NOT NULL")
    keyed = some.select(F.explode("bands").alias("key"), "h")
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    met = save(join_hot(keyed, shared, ["key"], F.col("n"), BANDS * some.count(), "inner").select("key", "h", "low"))
    edges = met.where("h > low").select("low", "h").distinct()
    lows = met.groupBy("h").agg(F.min("low").alias("low"))
    comps = connected_components(lows.select("h"), edges, vid="h", src="low", dst="h", canonical=True).withColumnRenamed("component", "comp")
    return met.select("key", "h"), save(comps.join(lows, "h"))


def blocks(sets: DataFrame) -> DataFrame:
    """(set, h, block): sets in order of component and least neighbour, cut
    into blocks of about ``BLOCK`` units, so that sets that share bands are mostly
    in one block or few."""
    ordered = global_row_number(sets.select("set", "h", "units", "comp", "low"), ["comp", "low", "set"], "no")
    ordered = ordered.withColumn("run", F.floor(F.col("no") / RUN))
    within = F.sum("units").over(Window.partitionBy("run").orderBy("no"))
    # One row for each RUN sets.
    before = F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    sums = ordered.groupBy("run").agg(F.sum("units").alias("all")).select("run", F.coalesce(before, F.lit(0)).alias("before"))
    upto = ordered.withColumn("upto", within).join(sums, "run")
    return save(upto.select("set", "h", F.floor((F.col("before") + F.col("upto") - 1) / BLOCK).alias("block")))


def _fetched(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, comps: DataFrame) -> DataFrame:
    """(set, h, n, units, comp, low, shingles), one row for each candidate
    set."""
    per_set = rows.where("set IS NOT NULL").groupBy("set", "h").agg(F.count(F.lit(1)).alias("n"), F.max("units").alias("units"), F.min(F.struct("doc_id", "tkey")).alias("one"))
    picked = save(per_set.join(comps, "h").select("set", "h", "n", "units", "comp", "low", F.col("one.doc_id").alias("_id"), F.col("one.tkey").alias("_tkey")))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("tkey"))
    got = texts.join(picked, (texts["tkey"] == picked["_tkey"]) & texts["doc_id"].eqNullSafe(picked["_id"])).select("set", "h", "n", "units", "comp", "low", "text")

    def run(batches):
        memo, seen = word_hashes(), Memo(lambda k: None, SEEN)
        for batch in slices(batches):
            keep, sets = [], []
            for k, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                if name not in seen:  # repeated rows
                    seen[name]
                    keep.append(k)
                    sets.append(shingles(text, memo).view(np.int64))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(sets, pa.list_(pa.int64()))], ["set", "h", "n", "units", "comp", "low", "shingles"])

    # A set comes more than once only where equal rows lie in several tasks.
    return save(got.mapInArrow(tidy(run), "`set` string, h bigint, n bigint, units bigint, comp bigint, low bigint, shingles array<bigint>").dropDuplicates(["set"]))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and (set, root, links) of every set that has a
    link to another set: the class's least set and the number of linked
    texts."""
    rows = sketched(docs, doc_id, text)
    keys, comps = candidates(rows)
    sets = _fetched(docs, doc_id, text, rows, comps)
    placed = blocks(sets)
    # Blocks meet that share a band value; a block meets itself.
    at = keys.join(placed.select("h", "block"), "h").select("key", "block").distinct()
    one, two = at.withColumnRenamed("block", "one"), at.withColumnRenamed("block", "two")
    pairs = save(one.join(two, "key").where("one < two").select("one", "two").distinct())
    held = sets.join(placed.select("set", "block"), "set").select("comp", "block", "set", "n", "shingles")
    sides = [held.join(pairs, held["block"] == pairs[side]) for side in ("one", "two")]
    own = held.withColumns({"one": F.col("block"), "two": F.col("block")})
    met = own.unionByName(sides[0]).unionByName(sides[1])
    # Blocks that meet themselves share groups, PACK at a time.
    pack = F.when(F.col("one") == F.col("two"), F.floor(F.col("one") / PACK)).otherwise(F.xxhash64("one", "two"))
    met = spread(met.withColumn("pack", pack).withColumn("apart", F.col("one") != F.col("two")), "pack", "apart")
    found = save(met.groupBy("pack", "apart").applyInPandas(_verify(least_matches(threshold, tolerance), threshold), "`set` string, root string, links bigint"))
    count = found.groupBy("set").agg(F.sum("links").alias("links"))
    edges = save(found.where("`set` <> root").select("root", "set").distinct())
    joined = connected_components(found.select("set"), edges, vid="set", src="root", dst="set", canonical=True)
    return rows, save(count.join(joined, "set").select("set", F.col("component").alias("root"), "links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, tkey, class_id, n_links, class_key, kept) of every row: the
    least doc_id of its class, the number of rows that it is linked to, a key of
    the class, and whether it is the first of its class by doc_id and text."""
    rows, found = links(docs, doc_id, text, threshold, tolerance)
    copies = rows.where("set IS NOT NULL").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")).alias("first"))
    sets = copies.join(found, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    sets = save(sets)
    whole = sets.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
    table = sets.select("set", "root", "n_links").join(whole, "root")
    out = rows.select("doc_id", "tkey", "set").join(table, "set", "left")
    kept = F.col("set").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("tkey").eqNullSafe(F.col("first.tkey")))
    return out.select("doc_id", "tkey", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("root").alias("class_key"), kept.alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but the first of each class; of
    repeated rows one stays, also of null, empty and blank texts."""
    kept = save(classes(docs, doc_id, text, **options).where("kept").select(F.col("doc_id").alias("_kept"), F.col("tkey").alias("_kkey")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_tkey"))
    # Spark drops repeated rows before the shuffle, as only number 1 is asked for.
    one = packed.withColumn("_no", F.row_number().over(Window.partitionBy("_id", "_tkey").orderBy(F.lit(1)))).where("_no = 1")
    return one.join(kept, one["_id"].eqNullSafe(kept["_kept"]) & one["_tkey"].eqNullSafe(kept["_kkey"])).select("_row.*")


def query(spark, sf_dir):
    """Class and number of links of every document."""
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
