import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL, lines_df

from logweave.functions.text import message_template
from logweave.operators.features import (embed, l2_normalize_long, ngram_features, sparse_cells,
                                         template_vector, with_template)
from logweave.operators.similarity import cosine


def test_templates(spark):
    df = spark.createDataFrame([("0x1F at 42",), ("Attempt 1/3 <x> 0xZZ",), (None,), ("!!!",)], "m string")
    got = [r.t for r in df.select(message_template("m").alias("t")).collect()]
    assert got == ["< > at < >", "attempt < > < > <x> < >xzz", None, ""]


def test_vector_golden():
    v = template_vector("connection refused to database")
    assert int((v != 0).sum()) == 33
    assert round(float(v[0]), 6) == 0.119098
    assert round(float(v[15]), 6) == 0.238197
    assert round(float(v[22]), 6) == 0.178647


def _cos(a, b):
    dot = np.cumsum((a * b).astype(np.float64))[-1]
    return dot / (np.sqrt(np.cumsum((a * a).astype(np.float64))[-1]) * np.sqrt(np.cumsum((b * b).astype(np.float64))[-1]))


def test_whole_line_similarities():
    def t(s):
        import re
        s = s.lower()
        s = re.sub(r"0x[0-9a-f]+", "<HEX>", s)
        s = re.sub(r"[0-9]+", "<NUM>", s)
        return re.sub(r"[^a-z<>]+", " ", s).strip()

    a = template_vector(t("2031-11-20 17:02:11 INFO Lock - Ferry 3 cleared the lock"))
    b = template_vector(t("2031-11-20 17:02:40 INFO Lock - Ferry 3 cleared the lock"))
    c = template_vector(t("2031-11-20 17:06:00 DEBUG Tower - Ice report: nothing new"))
    assert _cos(a, b) >= 0.99
    assert 0.7 < _cos(a, c) < 0.99


def test_long_form_equals_dense(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    long = l2_normalize_long(ngram_features(with_template(docs, "text"), "doc_id"), "doc_id")
    dense = sparse_cells(embed(docs, "doc_id", "text"), "doc_id")
    a = {(r.doc_id, r.k): round(r.value, 6) for r in long.collect()}
    b = {(r.doc_id, r.k): round(r.value, 6) for r in dense.collect()}
    assert a == b and len(a) > 1000


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])],
                               "a array<float>, b array<float>")
    got = [round(r.c, 6) for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got == [round(1 / np.sqrt(2), 6), 0.0, 0.0, 0.0]


def test_embed_dedupes_templates(spark):
    df = lines_df(spark, ["a 1", "a 2", None, "b"]).select("line_no", F.col("raw_line").alias("m"))
    v = {r.line_no: r.vector for r in embed(df, "line_no", "m").collect()}
    assert v[1] == v[2] and all(x == 0 for x in v[3]) and v[1] != v[4]


def test_batch_vectors_equal_single_ones():
    from logweave.operators.features import template_vectors

    some = ["a", "", None, "connection refused to database", "<num> x", "ab" * 500]
    assert (template_vectors(some) == np.stack([template_vector(x) for x in some])).all()


def test_null_templates_are_counted(spark):
    from logweave.operators.features import template_counts

    df = spark.createDataFrame([("b", 1, "t"), ("a", 9, "t"), ("a", 3, None), ("c", 1, None)], "source string, line_no bigint, template string")
    got = {r.template: (r.n, r.first_source, r.first_line_no) for r in template_counts(df).collect()}
    assert got == {"t": (2, "a", 9), None: (2, "a", 3)}
