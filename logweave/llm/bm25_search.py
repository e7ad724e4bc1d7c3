"""Exact BM25 top-k by an inverted index with block maxima: block-max WAND, a
block of documents at a time.

Every task turns its documents into inverted indexes of bounded size; parts that
are read together make a shard of at most ``POSTINGS`` postings, so the index is
never shuffled.  A shard numbers its documents by falling length and holds, for
each term, documents and term frequencies, and the greatest impact in every block
of ``BLOCK`` documents.

WAND moves the cursors of a query's lists to the next pivot, the first document
for which the lists' bounds add up to the present k-th score; with block maxima, a
pivot whose blocks' maxima add up to less is passed over.  Here the pivot is a
block: the maxima of all lists are added up for every aligned block (for many
queries by one matrix product), the cursors of all lists stop only in
blocks whose sum reaches the k-th score so far, and documents are scored there
and nowhere else.  The blocks of the longest documents come first and raise the
k-th score early.  A task answers its queries by one shard after the other, and the
k-th score so far is where the next shard begins.  Nothing that could enter the
result is dropped, so the result is exact.

Every query meets every shard, but no row is written for that: queries are packed
into bundles, and a task reads some shards and a group of bundles from the two
tables where they were written once.  The more groups of queries there are, the
more shards a task takes, so that it returns its queries' k best of all of these,
and what is written grows with the input, not with queries times shards.

A shard needs no statistics of others: it scores with the query's weights
(document frequencies summed over all shards) and the average length over all
documents, so shards' lists merge exactly.  Words are runs of letters, digits and
underscores, lower-cased; a query is the set of its words, k1 = 1.2, b = 0.75,
idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  Scores are rounded to 9 decimals,
ties go to the smaller id.

Defined cases: rows whose id or text is null take no part; a text without a word
counts as a document of length 0 and is never found; a query finds its own
row; documents that share no word with it are not returned, so it may have less
than k.  Repeated rows are documents of their own; queries of equal id are one, of
all their words.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Memo, read_table, save, scratch, slices, tidy, with_workers

K1, B = 1.2, 0.75
#: Documents of a block, blocks looked at together, and slack for sums in another order.
BLOCK, STEP, EPS = 64, 8, 1e-9
#: Postings of a shard, queries answered at a time, words of a bundle and of a task's queries, bytes of remembered words.
POSTINGS, AT_ONCE, BUNDLE, GROUP, WORDS = 4_000_000, 256, 500_000, 2_000_000, 32 << 20
#: Lists of at least this share of a shard's documents are kept as full rows.
DENSE = 1 / 8
PARTS = "n_docs bigint, n_words bigint, n_postings bigint, ids binary, lengths binary, terms binary, first binary, docs binary, tfs binary"
PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]
BUNDLES = "query_ids binary, counts binary, query_terms binary, idfs binary"
BUNDLE_NAMES = [c.split()[0] for c in BUNDLES.split(", ")]


def term_hashes() -> Memo:
    """Term to its 64-bit hash, the number under which it is indexed."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w) - (1 << 63), WORDS)


def small(x: np.ndarray) -> bytes:
    """Whole numbers as 16 or 32 bits, told apart by length."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int32)


class Shard:
    """ids and lengths of documents; for term ``terms[t]`` the postings
    ``first[t]`` to ``first[t + 1]`` of ``docs`` (rising) and ``tfs``."""

    def __init__(self, ids, lengths, terms, docs, tfs):
        """Of one entry for each document and term, documents rising."""
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        self.docs, self.tfs = docs.astype(np.int32)[order], tfs.astype(np.int32)[order]
        new = np.concatenate([[True], terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, bool)
        self.ids, self.lengths, self.terms = ids, lengths, terms[new]
        self.first = np.append(np.flatnonzero(new), len(terms))

    def row(self) -> list:
        return [len(self.ids), int(self.lengths.sum()), len(self.docs), self.ids.tobytes(), small(self.lengths), self.terms.tobytes(), self.first.astype(np.int64).tobytes(), small(self.docs), small(self.tfs)]

    @classmethod
    def read(cls, row: dict) -> Shard:
        """As it was before ``row``."""
        made = cls.__new__(cls)
        made.ids, made.lengths = np.frombuffer(row["ids"], np.int64), large(row["lengths"], row["n_docs"])
        made.terms, made.first = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["first"], np.int64)
        made.docs, made.tfs = large(row["docs"], row["n_postings"]), large(row["tfs"], row["n_postings"])
        return made

    @classmethod
    def merged(cls, rows: list[dict]) -> Shard:
        """Of several parts; documents are numbered anew, the longest first, so
        that documents of a block are of one length and its maxima are near
        what each can have."""
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        lengths = np.concatenate([large(r["lengths"], r["n_docs"]) for r in rows])
        by = np.lexsort((ids, -lengths))
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        terms, docs, tfs, at = [], [], [], 0
        for r in rows:
            terms.append(np.repeat(np.frombuffer(r["terms"], np.int64), np.diff(np.frombuffer(r["first"], np.int64))))
            docs.append(number[large(r["docs"], r["n_postings"]) + at])
            tfs.append(large(r["tfs"], r["n_postings"]))
            at += r["n_docs"]
        terms, docs, tfs = map(np.concatenate, (terms, docs, tfs))
        order = np.argsort(docs, kind="stable")
        return cls(ids[by], lengths[by], terms[order], docs[order], tfs[order])

    def weigh(self, average: float) -> None:
        """Impacts without idf, and their greatest in every block."""
        norm = K1 * (1 - B + B * self.lengths / (average or 1.0))
        self.docs = self.docs.astype(np.int64)  # as bincount and take want them
        self.impacts = self.tfs * (K1 + 1) / (self.tfs + norm[self.docs])
        n = len(self.ids)
        self.n_blocks = -(-n // BLOCK)
        # A row of impacts, 0 where the term is missing, for each frequent list, and one of their block maxima.
        self.often = np.flatnonzero(np.diff(self.first) >= max(DENSE * n, 64))
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[self.often] = np.arange(len(self.often))
        self.rows = np.zeros((len(self.often), self.n_blocks * BLOCK))
        for r, t in enumerate(self.often.tolist()):
            a, b = self.first[t], self.first[t + 1]
            self.rows[r, self.docs[a:b]] = self.impacts[a:b]
        self.row_max = self.rows.reshape(len(self.often), self.n_blocks, BLOCK).max(axis=2)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
        """The k best (id, score) of this shard for each query (terms, idfs).
        ``floor`` is a score that at least k documents of other shards reach:
        documents below it may be left out."""
        m, n = len(queries), len(self.ids)
        if not len(self.terms) or not m:
            return [[] for _ in range(m)]
        size = self.n_blocks * BLOCK
        weights, light, bound = np.zeros((m, len(self.often))), np.zeros((m, size)), np.zeros((m, self.n_blocks))
        for q, (terms, idf) in enumerate(queries):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            there = self.terms[at] == terms
            at, idf = at[there], idf[there]
            row = self.row_of[at]
            weights[q, row[row >= 0]] = idf[row >= 0]
            # Rare lists have few postings: these are added up at once.
            at, idf = at[row < 0], idf[row < 0]
            a, long = self.first[at], self.first[at + 1] - self.first[at]
            place = np.repeat(a - (np.cumsum(long) - long), long)
            place += np.arange(len(place))
            weight = np.repeat(idf, long)
            weight *= self.impacts.take(place)
            light[q] = np.bincount(self.docs.take(place), weight, minlength=size)
        # What a document of a block can have at most: maxima of the frequent lists, and of what the rare ones give.
        bound = weights @ self.row_max + light.reshape(m, self.n_blocks, BLOCK).max(axis=2)
        best = np.zeros((m, k)) if floor is None else np.repeat(floor[:, None], k, axis=1)
        seen_q, seen_d, seen_s = [], [], []
        for a in range(0, self.n_blocks, STEP):
            z = min(a + STEP, self.n_blocks)
            kth = best.min(axis=1)
            live = np.flatnonzero((bound[:, a:z] >= np.maximum(kth[:, None] - EPS, EPS)).any(axis=1))
            if not len(live):  # no list's cursor stops in these blocks
                continue
            docs = slice(a * BLOCK, z * BLOCK)
            score = weights[live] @ self.rows[:, docs] + light[live, docs]
            q, d = np.nonzero((score >= kth[live, None] - EPS) & (score > 0))
            seen_q.append(live[q])
            seen_d.append(d + docs.start)
            seen_s.append(score[q, d])
            # The floor stands for k documents elsewhere; better ones of this shard lift the k-th score.
            best[live] = np.partition(np.concatenate([best[live], score], axis=1), score.shape[1], axis=1)[:, score.shape[1] :]
        out: list[list[tuple[int, float]]] = [[] for _ in range(m)]
        if not seen_q:
            return out
        q, d, score = map(np.concatenate, (seen_q, seen_d, seen_s))
        score, kth = np.round(score, 9), best.min(axis=1)
        keep = np.flatnonzero((score >= kth[q] - EPS) & (d < n))
        q, ids, score = q[keep], self.ids[d[keep]], score[keep]
        for x in np.lexsort((ids, -score, q)).tolist():
            if len(out[q[x]]) < k:
                out[q[x]].append((int(ids[x]), float(score[x])))
        return out


def _batch(values: list, names: list[str]) -> pa.RecordBatch:
    """One row of numbers and bytes."""
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", postings: int | None = None) -> DataFrame:
    """The inverted index as a table of shards, a row each, written once.

    Tasks write parts of half a shard at most; what is left of many small tasks
    is read by fewer, which merge it.  Nothing is shuffled, and the parts go."""
    with_workers(docs.sparkSession)
    postings = postings or POSTINGS
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        memo = term_hashes()
        ids, lengths, terms, tfs = [], [], [], []

        def part():
            docs = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
            made = Shard(np.array(ids, np.int64), np.array(lengths, np.int64), np.concatenate(terms), docs, np.concatenate(tfs))
            for x in (ids, lengths, terms, tfs):
                x.clear()
            return _batch(made.row(), PART_NAMES)

        held = 0
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                count = Counter(words)
                ids.append(i)
                lengths.append(len(words))
                terms.append(np.fromiter(map(memo.__getitem__, count), np.int64, len(count)))
                tfs.append(np.fromiter(count.values(), np.int64, len(count)))
                held += len(count)
                if held >= postings // 2:
                    yield part()
                    held = 0
        if ids:
            yield part()

    def merge(batches):
        parts, held = [], 0
        for batch in slices(batches, 1):
            part = batch.to_pylist()[0]
            if parts and held + part["n_postings"] > postings:
                yield _batch(Shard.merged(parts).row(), PART_NAMES)
                parts, held = [], 0
            parts.append(part)
            held += part["n_postings"]
        if parts:
            yield _batch(Shard.merged(parts).row(), PART_NAMES)

    with scratch():
        parts = save(rows.mapInArrow(tidy(run), PARTS))
        total = parts.agg(F.sum("n_postings")).first()[0] or 0
        merged = parts.coalesce(max(1, round(total / postings))).mapInArrow(tidy(merge), PARTS)
        return save(merged.withColumn("shard", F.monotonically_increasing_id()))


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        for batch in slices(batches, 1):
            for terms, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(first, np.int64)))], ["term", "df"])

    return index.select("terms", "first").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _weighted(queries: DataFrame, index: DataFrame, n_docs: int, query_id: str, text: str) -> DataFrame:
    """(query_id, query_terms, idfs) of every query."""
    rows = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).alias("text")).where("query_id IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        memo = term_hashes()
        for batch in slices(batches):
            found = [[memo[w] for w in set(WORD.findall(t.lower()))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["query_id", "terms"])

    terms = rows.mapInArrow(tidy(run), "query_id bigint, terms array<bigint>").select("query_id", F.explode("terms").alias("term")).distinct()
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(document_frequencies(index), "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t"))
    return weighted.select("query_id", F.col("t.term").alias("query_terms"), F.col("t.idf").alias("idfs"))


def _bundled(asked: DataFrame) -> tuple[DataFrame, int]:
    """Queries in bundles of about ``BUNDLE`` words, a row each, written once in
    groups of about ``GROUP`` words, and the number of groups."""

    def run(batches):
        ids, terms, idfs, held = [], [], [], 0

        def bundle():
            counts = np.array([len(t) for t in terms], np.int64)
            made = [np.array(ids, np.int64), counts, np.concatenate(terms), np.concatenate(idfs)]
            for x in (ids, terms, idfs):
                x.clear()
            return _batch([x.tobytes() for x in made], BUNDLE_NAMES)

        for batch in slices(batches, AT_ONCE):
            for i, t, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids.append(i)
                terms.append(t.values.to_numpy())
                idfs.append(w.values.to_numpy())
                held += len(terms[-1])
                if held >= BUNDLE:
                    yield bundle()
                    held = 0
        if ids:
            yield bundle()

    with scratch():
        asked = save(asked)
        words = asked.agg(F.sum(F.size("query_terms"))).first()[0] or 0
        groups = max(1, -(-words // GROUP))
        bundles = asked.repartition(groups, "query_id").mapInArrow(tidy(run), BUNDLES)
        return save(bundles.withColumn("bundle", F.monotonically_increasing_id())), groups


def _answered(index: DataFrame, bundles: DataFrame, groups: int, average: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): of every task its queries' k best.  A task
    reads a group of bundles for each of its shards."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = index.select("shard", *PART_NAMES).coalesce(max(1, -(-tasks // groups)))
    # A product of partitions, both sides read anew for each: a join by broadcast or shuffle would hold or write one of them.
    rows = held.hint("shuffle_replicate_nl").crossJoin(bundles.coalesce(groups))

    def run(batches):
        shard, at, best = None, None, {}
        for batch in slices(batches, 1):
            number, bundle = batch.column("shard")[0].as_py(), batch.column("bundle")[0].as_py()
            if number != at:
                shard, at = Shard.read(batch.select(PART_NAMES).to_pylist()[0]), number
                shard.weigh(average)
            ids, counts, terms, idfs = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in zip(BUNDLE_NAMES, "qqqd", strict=True))
            ends = np.cumsum(counts)[:-1]
            queries = list(zip(np.split(terms, ends), np.split(idfs, ends), strict=True))
            if bundle not in best:
                best[bundle] = ids.tolist(), [[] for _ in queries]
            held = best[bundle][1]
            for a in range(0, len(queries), AT_ONCE):
                floor = np.array([h[-1][1] if len(h) == k else 0.0 for h in held[a : a + AT_ONCE]])
                for q, found in enumerate(shard.top(queries[a : a + AT_ONCE], k, floor), a):
                    if found:
                        held[q] = sorted(held[q] + found, key=lambda x: (-x[1], x[0]))[:k]
        for ids, held in best.values():
            flat = [x for found in held for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(found) for found in held]), pa.int64()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.float64())], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(tidy(run), "query_id bigint, doc_id bigint, score double")


def search(index: DataFrame, queries: DataFrame, query_id: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query."""
    n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    bundles, groups = _bundled(_weighted(queries, index, n_docs or 0, query_id, text))
    found = _answered(index, bundles, groups, (n_words or 0) / max(n_docs or 0, 1), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN tf USING (doc_id) WHERE d.doc_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
al AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
idf AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, al GROUP BY term, docs),
s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(idf * t.tf * {K1 + 1} / (t.tf + {K1} * ({1 - B} + {B} * n / mean))), 9) AS score
      FROM tf q JOIN idf USING (term) JOIN tf t USING (term) JOIN len ON len.doc_id = t.doc_id, al WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def query(spark, sf_dir):
    """The 10 best documents for each document whose id is divisible by 100."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(build_index(docs), docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))
