"""Mixing sources to target weights by Pareto order sampling.

Every source has a target, in words.  A document of inclusion weight ``w`` is
expected ``min(cap, c * w)`` times, where ``c`` makes the expected words of
its source meet the target.  The whole part is taken for certain; for the
fractional part ``p`` documents are ranked by random odds divided by inclusion
odds, ``(u / (1 - u)) / (p / (1 - p))`` (Rosen's Pareto sampling), and the
head of that order whose words come nearest the rest of the target is taken.

The weight of a document is its words up to ``FULL_WORDS``: short scraps are
repeated less.  No source is ever sorted in one task: the cut of the order is
found by two histograms of 4,096 cells for each source and a look at the rows of
one cell in 16 million.  ``u`` is a hash of the document, so reruns agree.

Defined cases: a null text has 0 words; a null source is a source of its
own, last in order; rows equal in doc_id and text have the same ``u`` and
stand or fall together; a table without words gets target 0 everywhere; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import global_row_number
from .common import join_hot, read_table, save, text_key, unit_hash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, FULL_WORDS, CELLS = (3, 1, 2), 1.5, 2.0, 200, 4096


def source_key(source: Column) -> Column:
    """``n`` for null, else ``s`` and the source: never null, same order."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc_id, tkey, key, size, u, bin), written once: all later passes read this."""
    t = F.col(text)
    size = F.coalesce(F.regexp_count(t, F.lit(WORDS)), F.lit(0)).cast("long")
    key = source_key(F.col(source))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(t).alias("tkey"), key.alias("key"), size.alias("size"))
    rows = rows.withColumn("u", unit_hash("doc_id", "tkey", seed=seed))
    return save(rows.withColumn("bin", F.least("size", F.lit(FULL_WORDS)).cast("int")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) from (key, source_size): sources by code
    point, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; what exceeds ``cap`` times a source's size is reshared by weight
    until none is above.  A round is one small aggregate."""
    ordered = sizes.withColumn("_null", F.col("key") == "n")  # the keys of named sources begin with s
    numbered = global_row_number(ordered, ["_null", "key"], "no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = save(numbered.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    total, w_all = src.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level, full = (goal / w_all if w_all else 0.0), -1
    while True:
        above = F.col("weight") * level >= F.col("most")
        n, taken, rest = src.agg(F.sum(above.cast("long")), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (n or 0) == full or not rest:
            break
        full, level = n, (goal - (taken or 0.0)) / rest
    return src.select("key", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _expected(rows: DataFrame, tgt: DataFrame, cap: float) -> DataFrame:
    """(key, bin, n, copies, p, rest): documents of that source and weight,
    their certain copies and inclusion probability, and the words that remain for
    the ranked draw.  At most FULL_WORDS rows for each source."""
    hist = rows.where("size > 0").groupBy("key", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).join(tgt.drop("n_rows"), "key")
    w = F.col("bin") / F.lit(float(FULL_WORDS))
    up = Window.partitionBy("key").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("key")
    heavier = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum(w * F.col("words")).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = (F.col("target") - cap * heavier) / lighter
    e = hist.withColumn("_c", c).withColumn("_c", F.max(F.when(F.col("_c") * w <= cap, F.struct("bin", "_c"))).over(whole)["_c"])
    e = e.withColumn("_e", F.coalesce(F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("_c") * w)), F.lit(cap)))
    near = F.abs(F.col("_e") - F.round("_e")) < 1e-9
    e = e.withColumn("copies", F.when(near, F.round("_e")).otherwise(F.floor("_e")).cast("long"))
    e = e.withColumn("p", F.when(near, 0.0).otherwise(F.col("_e") - F.col("copies")))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("copies") * F.col("words")).over(whole))
    return e.select("key", "bin", "n", "copies", "p", rest.alias("rest"))


def _cell(cells: DataFrame) -> DataFrame:
    """The cell of each source in which its words reach ``rest``, and what
    remains of ``rest`` there; no row if the words don't reach it."""
    run = Window.partitionBy("key").orderBy("cell")
    cum = F.sum("words").over(run)
    found = cells.withColumn("_cum", cum).where(F.col("_cum") >= F.col("rest"))
    return found.groupBy("key").agg(F.min(F.struct("cell", (F.col("rest") - F.col("_cum") + F.col("words")).alias("left"))).alias("m")).select("key", F.col("m.cell").alias("cut"), F.col("m.left").alias("left"))


def draw(rows: DataFrame, tgt: DataFrame, cap: float = CAP) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` (0 up to ``cap``)."""
    tgt = save(tgt.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "key"))
    expected = save(_expected(rows, tgt, cap))
    n = tgt.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # A source may hold a third of all rows, so its rows stay where they are.
    weighed = join_hot(rows.where("size > 0"), expected, ["key", "bin"], F.col("n"), n, "inner")
    named = weighed.select("doc_id", "tkey", "key", "size", "copies", F.when(F.col("p") > 0, odds / (1 + odds)).alias("q"), "rest")
    none = rows.where("size = 0").select("doc_id", "tkey", "key", "size", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("rest"))
    ranked = save(named.unionByName(none))
    cell1 = F.floor(F.col("q") * CELLS)
    cell2 = F.floor((F.col("q") * CELLS - cell1) * CELLS)
    drawn = ranked.where("q IS NOT NULL AND size > 0")
    one = _cell(drawn.groupBy("key", cell1.alias("cell"), "rest").agg(F.sum("size").alias("words")))
    # The rows of a source's cell: one in CELLS of its rows.
    inner = join_hot(drawn.drop("rest").withColumn("c1", cell1), one.join(tgt.select("key", "n_rows"), "key"), ["key"], F.col("n_rows"), n, "inner").where("c1 = cut").select("tkey", "doc_id", "key", "size", "q", F.col("left").alias("rest"))
    two = _cell(inner.groupBy("key", cell2.alias("cell"), "rest").agg(F.sum("size").alias("words")))
    last = inner.withColumn("c2", cell2).join(two, "key").where("c2 = cut").groupBy("key", "q", "tkey", "left").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("key").orderBy("q", F.col("tkey").asc_nulls_first())
    before = F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = last.withColumn("_ok", before + F.col("words") / 2 <= F.col("left"))
    edge = ends.groupBy("key").agg(
        F.max(F.when(F.col("_ok"), F.struct("q", F.coalesce("tkey", F.lit(b"")).alias("d")))).alias("upto"),
        F.min("q").alias("lowest"),
    )
    out = join_hot(ranked.drop("rest"), save(tgt.join(edge, "key", "left")), ["key"], F.col("n_rows"), n, "inner")
    here = F.struct("q", F.coalesce("tkey", F.lit(b"")).alias("d"))
    # No edge: the fractional documents together don't reach the rest, or none is needed.
    taken = F.when(F.col("q").isNull() | (F.col("size") == 0), False).when(F.col("upto").isNotNull(), here <= F.col("upto")).when(F.col("lowest").isNotNull(), F.col("q") < F.col("lowest")).otherwise(True)
    return out.select("doc_id", "tkey", "key", "size", "source_size", "target", (F.col("copies") + taken.cast("long")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11) -> DataFrame:
    """(doc_id, tkey, key, size, source_size, target, copies) of every row."""
    rows = measured(docs, doc_id, text, source, seed)
    tgt = save(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, cap))
    return draw(rows, tgt, cap)


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken."""
    got = mix(docs, doc_id, text, source, **options).where("copies > 0")
    copies = save(got.select("doc_id", "tkey", "key", "copies").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_tkey"), source_key(F.col(source)).alias("_key"))
    same = packed["_id"].eqNullSafe(copies["doc_id"]) & packed["_tkey"].eqNullSafe(copies["tkey"]) & (packed["_key"] == copies["key"])
    return packed.join(copies, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def query(spark, sf_dir):
    """What the mix takes of every document."""
    got = mix(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
