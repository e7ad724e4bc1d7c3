"""Feature extraction (E1-E6): templates, hashed character n-gram counts,
L2 normalisation, dense 128-float vectors.

Two equivalent forms:

* the *long* form ``(id, k, w)`` built from Spark expressions only
  (explode of character codes + ``groupBy``) - used for checks and for
  sparse consumers;
* the *dense* form ``array<float>`` built by a vectorised pandas UDF
  (``numpy.bincount`` over an Arrow batch).  It is applied to distinct
  templates only, so its cost follows the number of templates, not lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import message_template
from .joins import join_hot
from .tables import Written

DIM = fixed.VECTOR_DIM


def with_template(df: DataFrame, msg: str = "message", out: str = "template") -> DataFrame:
    """Add the message template (NULL message -> NULL template)."""
    return df.withColumn(out, message_template(msg))


def template_counts(df: DataFrame, template: str = "template", source: str = "source", line: str = "line_no") -> DataFrame:
    """Rows per template (a NULL template is a row of its own) and the
    first ``(source, line_no)`` that has it (hash aggregates with map-side
    partial aggregation: a hot template costs one row per task)."""
    from .firsts import first_keys

    return first_keys(df, [template], source, line).select(
        template, "n", F.col("_s").alias("first_source"), F.col("_l").alias("first_line_no"))


def ngram_features(df: DataFrame, id_col: str, template: str = "template",
                   kinds=("bigram", "unigram")) -> DataFrame:
    """E3/E4 long form: ``(id, k, w)`` summed per cell.

    Bigram cell ``((c1*31 + c2) ^ 17) % 128`` weight 1.0 per adjacent pair;
    unigram cell ``(c*13) % 128`` weight 0.5 per character.  Template
    characters are ``a-z``, ``<``, ``>`` and space, so cells are never
    negative.

    No lambdas: a look-ahead ``regexp_extract_all`` returns every
    overlapping character pair in one call, ``split(t, '')`` every
    character; one explode over both lists, and the cell is a codegen'd
    expression on the element (length 2 = bigram, 1 = unigram).
    """
    t = F.col(template)
    parts = []
    if "bigram" in kinds:
        parts.append(F.regexp_extract_all(t, F.lit("(?=(..))"), 1))
    if "unigram" in kinds:
        parts.append(F.split(t, ""))
    items = parts[0] if len(parts) == 1 else F.concat(*parts)
    e = df.where(t.isNotNull() & (F.length(t) > 0)).select(F.col(id_col), F.explode(items).alias("g"))
    c1 = F.ascii(F.substring("g", 1, 1))
    c2 = F.ascii(F.substring("g", 2, 1))
    big = F.length("g") == 2
    k = F.when(big, F.pmod((c1 * fixed.BIGRAM_MULT + c2).bitwiseXOR(F.lit(fixed.BIGRAM_XOR)), F.lit(DIM))).otherwise(
        F.pmod(c1 * fixed.UNIGRAM_MULT, F.lit(DIM)))
    w = F.when(big, F.lit(fixed.BIGRAM_WEIGHT)).otherwise(F.lit(fixed.UNIGRAM_WEIGHT))
    return e.select(id_col, k.alias("k"), w.alias("w")).groupBy(id_col, "k").agg(F.sum("w").alias("w"))


def l2_normalize_long(df: DataFrame, id_col: str, k: str = "k", w: str = "w") -> DataFrame:
    """E5 on the long form: ``value = float(w / sqrt(sum(float(w)^2)))``.

    Products are float x float (rounded to float), summed in double, the
    quotient is cast to float - the arithmetic of a float[] loop.  The
    per-id sum is a grouped aggregate joined back (partial aggregation;
    no window that would pull one id's rows into one buffer).
    """
    wf = F.col(w).cast("float")
    sq = df.groupBy(id_col).agg(F.sum(wf * wf).alias("_ss"))
    return df.join(sq, id_col).select(
        id_col, k,
        F.when(F.col("_ss") > 0, (F.col(w).cast("float") / F.sqrt("_ss")).cast("float"))
        .otherwise(F.col(w).cast("float")).alias("value"),
    )


# --- dense vectors (vectorised Python helper) --------------------------------

# Templates embedded at a time.
BATCH_ROWS = 1024


def template_vectors(templates: list[str | None]) -> np.ndarray:
    """Dense float32 vectors, a row for each template: one ``bincount`` over
    the cells ``row * DIM + cell`` of all of them."""
    raw = [t.encode("latin-1", "replace") if t else b"" for t in templates]
    c = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    pair = row[1:] == row[:-1]
    big = ((c[:-1] * fixed.BIGRAM_MULT + c[1:]) ^ fixed.BIGRAM_XOR) % DIM
    size = len(raw) * DIM
    v = fixed.BIGRAM_WEIGHT * np.bincount((row[1:] * DIM + big)[pair], minlength=size)
    v = v + fixed.UNIGRAM_WEIGHT * np.bincount(row * DIM + (c * fixed.UNIGRAM_MULT) % DIM, minlength=size)
    v32 = v.reshape(len(raw), DIM).astype(np.float32)
    # Sequential double sums of float products, in cell order.
    length = np.sqrt(np.cumsum((v32 * v32).astype(np.float64), axis=1)[:, -1:])
    return np.divide(v32, length, out=np.zeros((len(raw), DIM)), where=length > 0).astype(np.float32)


def template_vector(t: str | None) -> np.ndarray:
    """Dense float32 vector of one template."""
    return template_vectors([t])[0]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _embed_udf(t: pd.Series) -> pd.Series:
    texts = [x if isinstance(x, str) else "" for x in t]
    return pd.Series([v for a in range(0, len(texts), BATCH_ROWS) for v in template_vectors(texts[a:a + BATCH_ROWS])])


def embed_templates(c) -> Column:
    """Template column -> 128 floats (zeros for NULL/empty), one Arrow
    batch at a time."""
    from pyspark.sql import SparkSession

    from ..session import ship_package

    ship_package(SparkSession.getActiveSession())
    return _embed_udf(c)


def embed(df: DataFrame, id_col: str, msg: str = "message", dedupe: bool = True) -> DataFrame:
    """E6 for a table: ``(id, vector)``.

    ``dedupe=True`` (log lines: few templates, many repeats) embeds each
    distinct template once - a shuffle on the template with partial
    aggregation - and joins the vectors back.  ``dedupe=False`` (mostly
    unique texts such as documents) embeds row by row in place: no
    shuffle of long strings."""
    t = df.where(F.col(id_col).isNotNull()).select(id_col, message_template(msg).alias("template"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    if not dedupe:
        return t.select(id_col, F.coalesce(embed_templates("template"), zero).alias("vector"))
    # Templates meet under a 128-bit key; those on very many rows are sent to
    # the rows, and the empty ones (NULL too) need no vector.
    some = F.length("template") > 0
    t = t.withColumns({"_k1": F.when(some, F.xxhash64("template")), "_k2": F.when(some, F.xxhash64(F.lit(1), "template"))})
    counted = Written(t.where("_k1 IS NOT NULL").groupBy("_k1", "_k2", "template").agg(F.count(F.lit(1)).alias("_n")), "templates").df
    total = counted.agg(F.sum("_n")).first()[0] or 0
    vecs = counted.select("_k1", "_k2", "_n", embed_templates("template").alias("vector"))
    j = join_hot(t.select(id_col, "_k1", "_k2"), vecs, ["_k1", "_k2"], F.col("_n"), total)
    return j.select(id_col, F.coalesce(F.col("vector"), zero).alias("vector"))


def sparse_cells(df: DataFrame, id_col: str, vec: str = "vector") -> DataFrame:
    """Dense vector -> non-zero cells ``(id, k, value)``.

    ``posexplode_outer``: for a plain column input, ``posexplode`` makes
    Catalyst infer a ``size(vector) > 0`` filter and push it below the
    projection, which would evaluate the embedding UDF a second time."""
    return df.select(id_col, F.posexplode_outer(vec).alias("k", "value")).where(F.col("value") != 0)
