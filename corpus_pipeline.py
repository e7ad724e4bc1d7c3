"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input.

1. Language: texts without a letter, and texts that resemble none of the
   learned languages go: those with a cosine below ``LEAST_SCORE``, and longer
   ones below a cut that rises to ``LONG_SCORE``.
2. Toxicity: texts that the ordinal model calls toxic go.
3. Near duplicates: of each class of texts linked by a five-word Jaccard
   similarity of 0.8 or more, the first by doc_id stays.
4. Mixing: rows are repeated or left out to meet the sources' targets.
5. SentencePiece: every row's ids.

All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import language_id, mixing, ngram_jaccard, sentence_pieces, toxicity
from logweave.llm.common import read_table, save, scratch

#: Four deviations of the noise, 1/sqrt(4096), of a text in another script.
#: Random letters of a learned script resemble a language more the longer the
#: text is, up to 0.17; real texts of LONG letters and blanks score 0.24 at least.
LEAST_SCORE, LONG_SCORE, LONG = 0.065, 0.2, 600


def least_score(text: Column) -> Column:
    """The cut for a text, by its letters and the blanks between words."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}]+", " "))
    return F.lit(LEAST_SCORE) + F.least(n / LONG, F.lit(1.0)) * (LONG_SCORE - LEAST_SCORE)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language."""
    found = language_id.identifier(*language_id.fit(docs))(F.col("text"))
    return docs.where((found["lang"] != language_id.UNKNOWN) & (found["score"] >= least_score(F.col("text"))))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(F.col("text"))["p_toxic"] < toxicity.CUT)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near duplicates."""
    return ngram_jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces."""
    ids = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return ids.withColumn("n_tokens", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long"))


STAGES = [("language_id", language), ("toxicity", clean), ("ngram_jaccard", distinct), ("mixing", mix), ("sentence_pieces", encode)]

#: SQL can't express hyperdimensional profiles, fitted models and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with scratch():
        for _, stage in STAGES:
            with scratch():  # what the stage wrote on its way
                docs = save(stage(spark, docs, sf_dir))
    return docs
