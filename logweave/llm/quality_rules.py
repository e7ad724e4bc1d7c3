r"""Quality rules: base rules of each text, and cross-document line frequency.

Lines are normalised (A-Z and other capitals lower-cased, every digit 0, runs of
blanks one blank) and hashed to 64 bits.  A line's frequency is the number of
different texts of one host that hold it, so copies of a text count once; the
host of the tables here is ``source``.  A line is a host's boilerplate if more
than ``max(MIN_TEXTS, SHARE of the host's texts)`` hold it.  Its lines are removed
from every text of the host, and a text is rejected as depleted if less than
``LEFT`` of its words remain.  The base rules reject texts of less than
``MIN_WORDS`` words and texts of which more than ``REPEATED`` percent of the words
lie in three-word windows that occur twice in the text.

Everything is native: words and lines of a text are arrays handled in its own
row, whose three-word windows are found twice by sorting their hashes.  What is
needed of the lines, 12 bytes for each, is written once; the texts are read once
and never shuffled.  Lines are counted with partial aggregates; the joins back to
boilerplate lines and to hosts go through ``join_hot``, as one line or host may
hold a third of all rows.

64 bits: a text loses a clean line only if its hash meets that of a boilerplate
line of its host; with a million of those, once in 10**13 lines.  Windows are
compared by 64-bit hashes too, within one text.

Defined cases: a null text has no words, fails the base rules and is not kept; so
do empty texts; a null host is a host of its own; rows equal in all columns stay
and get equal results; an empty table gives no rows; other columns are ignored by
``judge`` and carried along by ``cleaned``.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, read_table, save, text_key

#: What stands between words, symbols, base rules.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MIN_WORDS, REPEATED = 50, 50
#: A boilerplate line is in more texts of its host than both; a text of which
#: less than LEFT remains is depleted.
MIN_TEXTS, SHARE, LEFT = 10, 0.01, 0.5


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that isn't null."""
    core = F.btrim(text, F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def repeated_words(word: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    window = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:  # of sorted windows, those whose neighbour is equal
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    # Each such window adds the words that the one before it doesn't hold.
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    add = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    count = lambda p: F.aggregate(p, start, add, lambda acc: acc["n"])
    found = lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(bound(F.array_sort(window(w)), lambda s: bound(places(s), count)))
    return bound(word, found)


def normal_lines(text: Column) -> Column:
    """Normalised lines of a text that isn't null, blank ones as ''."""
    low = F.translate(F.lower(text), "0123456789", "0" * 10)
    blanks = F.regexp_replace(low, r"[ \t\x0b\f\r]+", " ")
    return F.transform(F.split(blanks, "\n"), lambda x: F.btrim(x, F.lit(" ")))


def line_hashes(text: Column) -> Column:
    """(h, n): hash and words of every line with a word, in order."""
    full = F.filter(normal_lines(text), lambda x: x != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Base counts of each row and its lines, written once."""
    t = _or_empty(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(text_key(F.col(text))).alias("tkey"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"), repeated_words(words(t)).cast("long").alias("n_repeat_words"),
        line_hashes(t).alias("lines"),
    )
    n = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return save(rows).withColumn("n_words", n)


def boilerplate(rows: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> tuple[DataFrame, int]:
    """(host_key, h, common, rows) of the lines that may be common, and of
    those of which there are many, and the number of lines in all.

    One row stands for all copies of a text in a host; it carries their
    number.  Its different lines count once for the frequency and all of its
    lines, times the copies, for ``rows``."""
    texts = save(rows.groupBy("host_key", "tkey").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")))
    hosts = texts.groupBy("host_key").agg(F.count(F.lit(1)).alias("texts"))
    each = lambda hs, first: F.transform(hs, lambda h: F.struct(h.alias("h"), F.lit(first).alias("first")))
    all_lines = F.transform("lines", lambda x: x["h"])
    both = F.concat(each(F.array_distinct(all_lines), 1), each(all_lines, 0))
    one = rows.select("rid", "host_key", "lines").join(texts.select("rid", "copies"), "rid")
    lines = one.select("host_key", F.explode(both).alias("x"), "copies").select("host_key", "x.h", "x.first", "copies")
    counted = lines.groupBy("host_key", "h").agg(F.sum("first").alias("texts_with"), F.sum((1 - F.col("first")) * F.col("copies")).alias("rows"))
    total, n_texts = counted.agg(F.sum("rows")).first()[0] or 0, texts.count()
    counted = save(counted.where((F.col("texts_with") > min_texts) | (F.col("rows") * 10_000 > total)))
    # A host of n texts has at most so many of these lines as its texts have; hosts weigh their texts.
    known = join_hot(counted, save(hosts), ["host_key"], F.col("texts"), n_texts, "inner")
    common = (F.col("texts_with") > min_texts) & (F.col("texts_with") > F.col("texts") * share)
    return save(known.select("host_key", "h", common.alias("common"), "rows")), total


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_texts: int = MIN_TEXTS, share: float = SHARE, left: float = LEFT) -> tuple[DataFrame, DataFrame, int]:
    """(every row's counts and verdict, boilerplate lines with their rows, lines
    in all)."""
    # A null host is a key of its own: no host's name begins otherwise than with s.
    rows = measured(docs, doc_id, text, host).withColumn("host_key", host_key(F.col("host")))
    marks, total = boilerplate(rows, min_texts, share)
    lines = rows.select("rid", "host_key", F.explode("lines").alias("x")).select("rid", "host_key", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    removed = join_hot(lines, marks, ["host_key", "h"], F.col("rows"), total, "inner").where("common").groupBy("rid").agg(F.sum("n").alias("removed"))
    out = rows.join(removed, "rid", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed")) < F.lit(left) * F.col("n_words")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return out, marks.where("common").select("host_key", "h", "rows"), total


def host_key(host: Column) -> Column:
    return F.when(host.isNull(), "n").otherwise(F.concat(F.lit("s"), host))


def judge(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, removed) of every row; ``removed`` counts the words of
    boilerplate lines."""
    return judged(docs, **options)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed")


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the boilerplate lines of their hosts: the texts that
    have any are cut into lines, marked and put together again; the other rows
    pass by.  Line breaks next to a removed line go with it."""
    _, marks, total = judged(docs, doc_id=doc_id, text=text, host=host, **options)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    packed = save(docs.select(F.monotonically_increasing_id().alias("_rid"), row, host_key(F.col(f"`{host}`")).alias("host_key")))
    t = _or_empty(F.col(f"_row.`{text}`"))
    both = F.posexplode(F.arrays_zip(F.split(t, "\n").alias("raw"), normal_lines(t).alias("normal"))).alias("_at", "x")
    cut = lambda rows: rows.select("_rid", "host_key", both)
    lines = cut(packed).where("x.normal != ''").select("_rid", "_at", "host_key", F.xxhash64("x.normal").alias("h"))
    hit = save(join_hot(lines, marks, ["host_key", "h"], F.col("rows"), total, "inner").select("_rid", "_at"))
    touched = hit.select("_rid").distinct()
    changed = cut(packed.join(touched, "_rid", "left_semi")).select("_rid", "_at", "x.raw").join(hit, ["_rid", "_at"], "left_anti")
    text_of = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_at", "raw"))), lambda x: x["raw"]))  # one text's lines
    new = touched.join(changed.groupBy("_rid").agg(text_of.alias("_new")), "_rid", "left").withColumn("_new", _or_empty(F.col("_new")))
    kept = F.coalesce("_new", F.col(f"_row.`{text}`")).alias(text)
    return packed.join(new, "_rid", "left").select(*[kept if c == text else F.col(f"_row.`{c}`").alias(c) for c in names])


def query(spark, sf_dir):
    """Base rules and line frequency of all documents."""
    return judge(read_table(spark, sf_dir, "documents"))
