"""Phrase collocations, counted with quotient filters.

1. Every task cuts its texts into words and writes them in chunks of
   ``CHUNK`` words of one language: the chunk's own words with their counts, and
   the text as numbers of these words.  0 is the border between pieces.
2. The counts of words are added up.  Words below ``least`` are in no candidate;
   the others get dense ids, so that ids take few bits.
3. Every chunk gets the ids of its words by joins.  Its pairs and triples of
   neighbouring words, packed and permuted, go into counting quotient filters
   (``quotient_filter``), one for each block of fingerprints.
4. Filters of a block are merged.  Fingerprints look random, so blocks are of
   one size whatever the phrases, and a phrase on every page is one counter in
   each chunk.  The counters are exact, as the whole fingerprint is kept.
5. Phrases of at least ``least`` occurrences are scored by joins to their parts.

The number of blocks grows with the words, so that one has at most
``PER_BLOCK`` counters.  Tables whose keys may be hot (frequent words, and pairs
that begin many phrases) are joined by ``join_hot``.

A piece is a part of a text between any of ``.,;:!?`` and U+000A to U+000D, a word a
run of other characters than blank and tab in it; only A to Z are lower-cased.

Defined cases: a null text is empty, a null language is ``und``; texts without a
word count nothing; repeated rows count as often as they stand; an empty table
gives no rows; other columns are ignored.  Texts are read whole: long ones are
cut at a border or blank, with an overlap.  Occurrences of a phrase may number up to
10**15.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import global_row_number
from .common import join_hot, read_table, save, tidy, with_workers
from .quotient_filter import Filter, Packing, blocks, counted

UNKNOWN, LEAST, TOP, MILLION = "und", 10, 2000, 1_000_000
#: Words of a chunk, bytes cut into words at a time, and counters of a block.
CHUNK, SLICE, PER_BLOCK = 1_000_000, 1 << 20, 1_000_000
BORDERS = b".,;:!?\n\x0b\x0c\r"
TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+").findall
GAP = re.compile(rb"[ \t.,;:!?\n-\r]").search


class Numbers(dict):
    """A number for every word, from 1 in order of appearance; 0 for borders."""

    def __missing__(self, word: bytes) -> int:
        if word[0] in BORDERS:
            return 0
        n = self[word] = len(self) + 1
        return n


class Buffer:
    """Words of one language, as numbers."""

    def __init__(self):
        self.numbers, self.parts, self.size = Numbers(), [], 0

    def add(self, text: bytes) -> int:
        before, a = self.size, 0
        while a < len(text):
            cut = GAP(text, a + SLICE)
            z = cut.end() if cut else len(text)
            part = np.array([*map(self.numbers.__getitem__, TOKENS(text[a:z]))], np.int32)
            self.parts.append(part)
            self.size += len(part)
            a = z
        self.parts.append(np.zeros(1, np.int32))
        return self.size - before

    def rows(self, chunk: int) -> Iterator[tuple[int, bytes, list[bytes], list[int]]]:
        """(starts, numbers, words, counts): phrases begin in the first
        ``starts`` places; the two more that long ones have belong to the next."""
        ids = np.concatenate(self.parts)
        names = [b"", *self.numbers]
        for a in range(0, len(ids), chunk):
            part = ids[a : a + chunk + 2]
            starts = min(chunk, len(ids) - a)
            used, own = np.unique(part, return_inverse=True)
            n = np.bincount(own[:starts], minlength=len(used))
            if used[0] != 0:  # borders are number 0 in every chunk
                own, used, n = own + 1, np.concatenate([[0], used]), np.concatenate([[0], n])
            yield starts, own.astype("<i4").tobytes(), [names[u] for u in used[1:].tolist()], n[1:].tolist()


def chunks(docs: DataFrame, text: str, lang: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk, lang, starts, numbers, words, counts), written once."""
    with_workers(docs.sparkSession)

    def flush(buffers):
        for name, b in buffers.items():
            for starts, numbers, words, counts in b.rows(chunk):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([starts], pa.int32()), pa.array([numbers], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
                    ["lang", "starts", "numbers", "words", "counts"],
                )

    def run(batches):
        buffers: dict[str, Buffer] = {}
        size = 0
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if t:
                    size += buffers.setdefault(name.as_py(), Buffer()).add(t.encode().lower())
                if size >= chunk:
                    yield from flush(buffers)
                    buffers, size = {}, 0
        yield from flush(buffers)

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    got = rows.mapInArrow(tidy(run), "lang string, starts int, numbers binary, words array<binary>, counts array<bigint>")
    return save(got.select(F.monotonically_increasing_id().alias("chunk"), "*"))


def word_counts(parts: DataFrame) -> DataFrame:
    """(lang, word, f)."""
    pairs = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return pairs.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))


def filters(parts: DataFrame, vocabulary: DataFrame, bits: int, prefixes: dict[int, int]) -> DataFrame:
    """(size, block, filter) of every chunk."""
    named = parts.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    ids = named.groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))  # a chunk's words at most

    def run(batches):
        packings = {k: Packing(k, bits) for k in prefixes}
        for batch in batches:
            for starts, numbers, known in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                own = np.frombuffer(numbers.as_py(), "<i4")
                id_of = np.zeros(int(own.max()) + 1, np.int64)
                fields = known.values.flatten()
                id_of[fields[0].to_numpy() + 1] = fields[1].to_numpy()
                word = id_of[own]
                for k, packing in packings.items():
                    n = min(starts.as_py(), len(word) - k + 1)
                    if n <= 0:
                        continue
                    columns = [word[j : j + n] for j in range(k)]
                    there = np.all([c > 0 for c in columns], axis=0)
                    made = counted(*packing.permute(*packing.pack([c[there] for c in columns])))
                    got = list(blocks(packing, prefixes[k], *made))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(got), pa.int32()), pa.array([f.block for f in got], pa.int64()), pa.array([f.dump() for f in got], pa.binary())],
                        ["size", "block", "filter"],
                    )

    return parts.join(ids, "chunk").select("starts", "numbers", "ids").mapInArrow(tidy(run), "size int, block bigint, filter binary")


def merged(shards: DataFrame, bits: int, prefixes: dict[int, int], least: int) -> DataFrame:
    """(size, w1, w2, w3, a): phrases of at least ``least`` occurrences, w3 0
    for pairs."""

    def run(table: pa.Table) -> pa.Table:
        size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
        packing = Packing(size, bits)
        f = Filter.merge([Filter.load(packing, prefixes[size], block, x.as_py()) for x in table.column("filter")])
        often = f.counts >= least
        words = [w[often] for w in f.keys()]
        n = int(often.sum())
        words += [np.zeros(n, np.int64)] * (3 - size)
        return pa.table({"size": np.full(n, size, np.int32), "w1": words[0], "w2": words[1], "w3": words[2], "a": f.counts[often]})

    return shards.groupBy("size", "block").applyInArrow(run, "size int, w1 bigint, w2 bigint, w3 bigint, a bigint")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, chunk: int = CHUNK, per_block: int = PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The candidates of two words, (w1, w2, a, lang, word1, word2, f1, f2), and
    of three, (w1, w2, w3, a), and the words of all texts."""
    parts = chunks(docs, text, lang, chunk)
    counts = save(word_counts(parts))
    total = counts.agg(F.sum("f")).first()[0] or 0
    vocabulary = save(global_row_number(counts.where(F.col("f") >= least), ["lang", "word"], "id"))
    n = vocabulary.count()
    bits = max(1, int(n).bit_length())
    prefix = max(0, (int(total) // per_block).bit_length())
    prefixes = {k: min(prefix, Packing(k, bits).half) for k in (2, 3)}
    grams = save(merged(filters(parts, vocabulary, bits, prefixes), bits, prefixes, least))
    two = grams.where("size = 2").select("w1", "w2", "a")
    # A word of frequency f begins or ends at most f / least candidates.
    first = vocabulary.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1"), F.col("f").alias("f1"))
    second = vocabulary.select(F.col("id").alias("w2"), F.col("word").alias("word2"), F.col("f").alias("f2"))
    two = join_hot(two, first, ["w1"], F.col("f1"), total, "inner")
    two = join_hot(two, second, ["w2"], F.col("f2"), total, "inner")
    three = grams.where("size = 3").select("w1", "w2", "w3", "a")
    return save(two), three, counts.groupBy("lang").agg(F.sum("f").alias("n")), total


def score(a, left, right):
    """floor(1000000 * a * a / (left * right)), exact."""
    d = lambda x: F.col(x).cast("decimal(15,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(MILLION).cast("decimal(7,0)"), d(left) * d(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``."""
    two, three, words, total = phrases(docs, text, lang, least, **options)
    # A pair of frequency a begins or ends at most a / least candidates.
    begin = two.select("w1", "w2", "lang", "word1", "word2", "f1", F.col("a").alias("a12"))
    end = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    three = join_hot(three, begin, ["w1", "w2"], F.col("a12"), total, "inner")
    three = save(join_hot(three, end, ["w2", "w3"], F.col("a23"), total, "inner"))
    pair = lambda x, y: three.select(F.col(x).alias("w1"), F.col(y).alias("w2"), F.col("a").alias("longer"))
    inside = pair("w1", "w2").unionByName(pair("w2", "w3")).groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
    kept = two.join(inside, ["w1", "w2"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    text_of = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    out2 = kept.select("lang", text_of("word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    one, other = score("a", "f1", "a23"), score("a", "a12", "f3")
    out3 = three.select(
        "lang", text_of("word1", "word2", "word3").alias("phrase"), "a",
        F.when(one <= other, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(one <= other, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least(one, other).alias("score"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = out2.unionByName(out3).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # The first of each part of a language, then of all its parts.
    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top).drop("_r", "_salt")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    """Each language's first collocations over all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3]) AS k FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, l.f AS l, r.f AS r,
    ({MILLION}::HUGEINT * x.a * x.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts x
  JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[:x.c], ' ') AND l.k = x.c
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1:], ' ') AND r.k = x.k - x.c),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT x.* FROM lowest x LEFT JOIN longer y ON x.k = 2 AND y.lang = x.lang AND y.inner_phrase = x.phrase
  WHERE y.longer IS NULL OR 100 * y.longer < 50 * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""
